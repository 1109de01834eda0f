"""Secret scans with a random forest that tells real findings from false positives, in DataFrame functions only.

A *candidate* is a run of at least ``SHORTEST`` characters of ``[A-Za-z0-9+/_-]`` with its trailing ``=``, or, behind an
assignment or a word for credentials, a run of any characters but white space and quotation marks, of ``ASSIGNED_SHORTEST``
at least (less full stops, commas and closing brackets at its end). A text is split at its candidates once, so each one
comes with what stands before and behind it. The forest sees

* its length, and the shares of digits, capitals and hexadecimal digits,
* its character transitions: changes between letters and digits, between small letters and capitals, repeated
  characters, distinct characters, and the share of marks,
* its dictionary coverage: the share of its characters in frequent words of four to twelve letters. The list has the
  ``DICTIONARY`` words that most sources have (told apart by 64 classes), then the most frequent ones, counted over all
  documents, so that no source's words fill it by being many; candidates are looked up in it as a prefix tree,
* its path: whether the document's source, or a path in the text ahead of it, looks like tests, examples or fixtures,
* its neighbouring words: an assignment, a quotation mark, a word for credentials, a word for hashes or identifiers, and a
  word for placeholders before it or in it.

The forest is trained on labelled findings (``FINDINGS`` rows at most). There is no such table among the inputs, so
``labelled_findings`` makes one by rule: assigned keys and passwords in several alphabets and lengths as true ones; long
words (in capitals and run together too), card and telephone numbers, file paths, commit hashes, checksums, UUIDs and placeholders as false ones.

Defined cases: null and empty texts have no candidates; repeated rows have their findings each; null sources and ids are
kept as they are; the length of a text and the number of its candidates are not bounded; columns of docs that are called
like one of the result are replaced; of words that are equally frequent the first by the alphabet is in the dictionary; an
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import documents, materialise

SHORTEST = 16
#: Characters of an assigned candidate.
ASSIGNED_SHORTEST = 4
SECRET_WORD = r"(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|apikey|access[_\-]?key|credentials?|bearer|authorization)"
#: What stands ahead of an assigned candidate; bounded, as a look behind has to be.
AHEAD = rf"(?<=[\s=:\"'`])(?<=(?i:{SECRET_WORD})[\"'`]{{0,1}}[\s=:]{{1,4}}[\"'`]{{0,1}}|[A-Za-z0-9_\]\"']\s{{0,2}}=\s{{0,2}}[\"'`]{{0,1}}|:\s{{0,2}}[\"'`])"
RUN = rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}"
CANDIDATE = rf"{AHEAD}[^\s\"'`=:][^\s\"'`]{{{ASSIGNED_SHORTEST - 2},}}(?<![.,;:)\]}}])|[A-Za-z0-9+/_\-]{{{SHORTEST},}}={{0,2}}"
#: Characters ahead of and behind a candidate that count as its neighbours.
BEFORE, BEHIND = 40, 24
FINDINGS = 6000
DICTIONARY = 4000
TREES, DEPTH, SEED = 40, 7, 7

CREDENTIAL = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|credential|bearer|authorization)[^A-Za-z0-9]*$"
HASHED = r"(?i)(commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|revision)[^A-Za-z0-9]*$"
PLACEHOLDER = r"(?i)(example|dummy|sample|placeholder|changeme|your[_-]|xxxx|test|fake|0000)"
FIXTURE = r"(?i)(^|[/_.-])(tests?|examples?|fixtures?|samples?|mocks?|docs?)([/_.-]|$)"

FIXTURE_PATH = r"(?i)[a-z0-9_.-]*/(?:[a-z0-9_.-]+/)*(tests?|examples?|fixtures?|samples?|mocks?)/[a-z0-9_./-]*[\s:]"

FEATURES = ["f_length", "f_digits", "f_capitals", "f_hex", "f_class_changes", "f_case_changes", "f_repeats", "f_distinct", "f_covered", "f_fixture", "f_assigned", "f_quoted", "f_credential", "f_hashed", "f_placeholder", "f_slashes", "f_marks"]


def _maybe_assigned(text: Column) -> Column:
    """Whether a text has what an assigned candidate needs ahead of it: an equals sign, a colon and a mark, or a word for credentials. It spares other texts the search."""
    small = F.lower(text)
    out = text.contains("=") | text.rlike(":\\s{0,2}[\"'`]")
    for part in ("token", "secret", "passw", "pwd", "key", "credential", "bearer", "authorization"):
        out = out | small.contains(part)
    return out


NEW = ("candidate", "before", "behind", "start")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with ``candidate``, ``before``, ``behind`` and ``start`` (code points) of each candidate, which replace docs' own."""
    own = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text and c not in NEW]
    kept = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.lit(None)
    rows = docs.select(kept.alias("_kept"), own.alias("_text"), _maybe_assigned(own).alias("_maybe"))
    rows = rows.where(F.col("_text").rlike(RUN) | (F.col("_maybe") & F.col("_text").rlike(CANDIDATE)))
    # In a text without anything assigned, runs alone can be candidates, which are found much faster.
    either = lambda find: F.when(F.col("_maybe"), find(CANDIDATE)).otherwise(find(RUN + "={0,2}"))
    rows = rows.select("_kept", either(lambda p: F.split("_text", p, -1)).alias("_parts"), either(lambda p: F.regexp_extract_all("_text", F.lit(p), F.lit(0))).alias("_found"))
    # Each candidate with the part before it and the head of the part behind it; its start is the length of all before.
    cut = F.transform("_parts", lambda p: F.struct(F.char_length(p).cast("long").alias("n"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(BEHIND)).alias("head")))
    rows = rows.select("_kept", "_found", cut.alias("_cut"))
    steps = F.zip_with("_found", F.slice("_cut", 1, F.size("_found")), lambda c, p: F.struct(p["n"].alias("gap"), F.char_length(c).cast("long").alias("n")))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate(steps, none, lambda a, x: F.struct((a["at"] + x["gap"] + x["n"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")), lambda a: a["starts"])
    zipped = F.arrays_zip(F.col("_found").alias("candidate"), F.transform(F.slice("_cut", 1, F.size("_found")), lambda p: p["tail"]).alias("before"), F.transform(F.slice("_cut", 2, F.size("_found")), lambda p: p["head"]).alias("behind"), starts.alias("start"))
    rows = rows.select("_kept", F.explode(zipped).alias("_z"))
    return rows.select(*(F.col(f"_kept.`{c}`") for c in rest), *(F.col(f"_z.{n}") for n in NEW))


def dictionary(docs: DataFrame, text: str = "text", source: str | None = "source", most: int = DICTIONARY) -> list[str]:
    """``most`` words of four to twelve small letters: those of most sources first, then the most frequent in all documents."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?<!\p{L})\p{Ll}{4,12}(?!\p{L})"), F.lit(0)))
    # Sources by 64 classes of their hash: a word's classes are one number, so a task sends a row for each word.
    place = F.pmod(F.xxhash64(F.col(source).cast("string")), F.lit(64)).cast("int") if source else F.lit(0)
    rows = docs.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place).alias("s"))
    counts = rows.groupBy("w").agg(F.bit_count(F.bit_or("s")).alias("places"), F.count(F.lit(1)).alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("places"), F.desc("n"), "w").limit(most).collect()]  # ``most`` rows


def _share(candidate: Column, pattern: str) -> Column:
    return F.regexp_count(candidate, F.lit(pattern)).cast("double") / F.char_length(candidate)


def _any_of(words: list[str]) -> str:
    """A pattern of the longest of these words, as the prefix tree that they make."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        ways = [re.escape(c) + shown(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        whole = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{whole}?" if "" in node else whole

    return shown(tree)


def _covered(small: Column, words: list[str]) -> Column:
    """The share of a candidate's characters that lie in words of the list, the longest at each place."""
    return 1 - F.char_length(F.regexp_replace(small, _any_of(words), "")).cast("double") / F.char_length(small)


def featured(findings: DataFrame, words: list[str], path: str | None = "source") -> DataFrame:
    """findings (candidate, before, behind and the path's column) with FEATURES."""
    c = F.col("candidate")
    n = F.char_length(c).cast("double")
    covered = _covered(F.lower(c), words) if words else F.lit(0.0)
    place = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return findings.withColumns(
        {
            "f_length": F.least(n, F.lit(200.0)),
            "f_digits": _share(c, "[0-9]"),
            "f_capitals": _share(c, "[A-Z]"),
            "f_hex": _share(c, "[0-9a-fA-F]"),
            "f_class_changes": _share(c, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
            "f_case_changes": _share(c, "(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "f_repeats": _share(c, r"(.)(?=\1)"),
            "f_distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(n, F.lit(40.0)),
            "f_covered": covered,
            "f_fixture": flag(place.rlike(FIXTURE) | F.col("before").rlike(FIXTURE_PATH)),
            "f_assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
            "f_quoted": flag(F.col("before").rlike(r"[\"'`]$") & F.col("behind").rlike(r"^[\"'`]")),
            "f_credential": flag(F.col("before").rlike(CREDENTIAL)),
            "f_hashed": flag(F.col("before").rlike(HASHED)),
            "f_placeholder": flag(c.rlike(PLACEHOLDER) | F.col("before").rlike(PLACEHOLDER)),
            "f_slashes": _share(c, "[/_-]"),
            "f_marks": _share(c, r"[^\p{L}\p{N}/_.\-]"),
        }
    )


def labelled_findings(spark: SparkSession, words: list[str], most: int = FINDINGS) -> DataFrame:
    """candidate, before, behind, source and label of ``most`` findings, each made from its number alone."""
    rows = spark.range(most).select("id", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256).alias(f"h{k}") for k in range(3)))
    hexes, more = F.concat("h0", "h1"), F.concat("h1", "h2")
    pick = lambda k, n: (F.conv(F.substring("h2", k, 4), 16, 10).cast("int") % n)
    # One literal: an array of literals would be in the plan as often as a word is drawn, with a node for each word.
    listed = F.split(F.lit(" ".join(words or ["lorem", "ipsum", "dolor"])), " ")
    # One word in four is of no dictionary: hexadecimal digits as letters, vowels among them.
    strange = lambda k: F.translate(F.substring("h1", k, 6), "0123456789abcdef", "aeioutsnrldmcpvg")
    known = lambda k: F.element_at(listed, (pick(k, len(words or [0, 0, 0])) + 1).cast("int"))
    word = lambda k: F.when(pick(61, 4) == 0, strange(k)).otherwise(known(k))
    base64 = F.regexp_replace(F.base64(F.unhex(hexes)), "[+/=]", "Q")
    # True findings have a secret's name ahead of nine in ten; false ones have another word, or none.
    name = F.element_at(F.array(*map(F.lit, ["token", "password", "secret", "api_key", "apikey", "access_key", "Authorization: Bearer", "passwd"])), pick(1, 8) + 1)
    sign = F.element_at(F.array(*map(F.lit, [' = "', "=", ": ", ' = "', "='", ' "'])), pick(5, 6) + 1)
    close = F.when(sign.contains('"'), '" ').when(sign.contains("'"), "' ").otherwise(" ")
    # Short and with punctuation: passwords of people.
    short = [
        F.substring(base64, 1, 8),
        F.substring(base64, 2, 12),
        F.substring(hexes, 1, 10),
        F.concat(F.substring(word(3), 1, 7), F.substring(F.translate(hexes, "abcdef", "012345"), 1, 1)),
        F.concat(F.initcap(F.substring(base64, 1, 4)), F.lit("&"), F.substring(base64, 9, 5)),
        F.concat(F.substring(base64, 1, 7), F.lit("."), F.substring(base64, 9, 7), F.lit("@!")),
        F.regexp_replace(F.concat(F.substring(base64, 1, 3), F.lit("#"), F.substring(base64, 5, 2), F.lit("%"), F.substring(base64, 9, 3)), "(?<=[A-Za-z])(?=[A-Za-z])", "."),
    ]
    true = F.element_at(F.array(F.substring(hexes, 1, 40), F.substring(hexes, 1, 18), F.substring(base64, 1, 40), F.concat(F.lit("AKIA"), F.upper(F.substring(base64, 5, 16))), F.concat(F.lit("ghp_"), F.substring(base64, 3, 36)), F.substring(hexes, 1, 32), F.substring(base64, 1, 24), F.upper(F.substring(hexes, 1, 40)), *short), pick(9, 8 + len(short)) + 1)
    filler = F.element_at(F.array(*map(F.lit, ["example", "changeme", "placeholder", "your", "sample", "dummy"])), pick(21, 6) + 1)
    digits = F.regexp_replace(F.translate(hexes, "abcdef", "012345"), "[^0-9]", "")
    false = F.element_at(
        F.array(
            F.concat(word(3), word(7), word(11), word(15), word(19)),
            F.concat(word(3), word(7), word(11), word(15)),
            F.concat(word(7), F.lit("/"), word(3), F.lit("/"), word(11), F.lit("-"), word(15)),
            F.concat(word(7), F.lit("_"), word(3), F.lit("_"), word(11), F.lit("_"), word(15)),
            F.substring(digits, 1, 16),
            F.concat_ws("-", F.substring(more, 1, 8), F.substring(more, 9, 4), F.substring(more, 13, 4), F.substring(more, 17, 4), F.substring(more, 21, 12)),
            F.substring(more, 1, 40),
            F.substring(more, 1, 64),
            F.concat(F.lit("your_"), word(3), F.lit("_key_example_"), F.substring(more, 1, 6)),
            F.concat(F.repeat(F.lit("x"), 20), F.substring(more, 1, 2)),
            F.initcap(F.concat(word(3), word(7), word(11), word(15))),
            F.upper(F.concat(word(3), word(7), word(11), word(15))),
            F.substring(F.concat(word(3), word(7), word(11), word(15), word(19)), 2, 18),
            word(3),
            F.concat(word(3), F.lit("."), word(7)),
            F.substring(digits, 1, 5),
            word(3),
            F.concat(F.initcap(word(3)), F.initcap(word(7)), F.initcap(word(11)), F.initcap(word(15))),
            F.concat(word(3), F.initcap(word(7)), F.initcap(word(11)), F.initcap(word(15))),
            F.concat(filler, F.lit("-"), word(3), F.lit("-"), word(7)),
            F.concat(word(3), F.lit("-"), word(7), F.lit("-"), filler),
        ),
        pick(13, 21) + 1,
    )
    kind = pick(13, 21)
    led = F.when(kind.isin(6, 7), F.element_at(F.array(*map(F.lit, ["commit ", "sha256: ", "checksum=", "md5 = "])), pick(17, 4) + 1)).when(kind == 5, "uuid: ").when(kind.isin(8, 9, 19, 20), F.concat(name, sign)).when(kind.isin(13, 14, 15), F.concat(word(17), sign)).when(kind == 16, F.concat(name, F.lit(" ")))
    is_true = pick(21, 2) == 1
    other = F.concat(word(23), F.lit(" "), word(27), F.lit(" "))
    before = F.when(is_true, F.concat(other, F.when(pick(25, 10) > 0, F.concat(name, sign)).otherwise(F.lit("")))).otherwise(F.concat(other, F.coalesce(led, F.lit(""))))
    behind = F.concat(F.when(is_true | kind.isin(8, 9, 13, 14, 15, 19, 20), close).otherwise(F.lit(" ")), word(29))
    source = F.when(~is_true & (pick(29, 6) == 0), "tests/fixtures/data").otherwise(F.concat(F.lit("src"), pick(33, 20)))
    made = rows.select(F.when(is_true, true).otherwise(false).alias("candidate"), F.right(before, F.lit(BEFORE)).alias("before"), F.left(behind, F.lit(BEHIND)).alias("behind"), source.alias("source"), is_true.cast("double").alias("label"))
    # Written, as a filter over the expressions above would have them all twice.
    return materialise(made, "findings").where(F.char_length("candidate") >= ASSIGNED_SHORTEST)


def train(findings: DataFrame, words: list[str], trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured(findings, words).coalesce(1))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label").fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, source, ``start``, ``length``, ``candidate_sha256``, ``probability``, ``is_secret``."""
    words = dictionary(docs)
    model = train(labelled_findings(docs.sparkSession, words) if findings is None else findings, words)
    # Candidates are few and short beside the texts; written first, the features are a plan of their own.
    rows = featured(materialise(candidates(docs.select("doc_id", "source", "text")), "candidates"), words)
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    p = vector_to_array("probability")[1]
    return scored.select(
        "doc_id",
        "source",
        "start",
        F.char_length("candidate").cast("long").alias("length"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        p.alias("probability"),
        (p >= 0.5).alias("is_secret"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
