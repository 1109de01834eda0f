"""Prefix hashes and raking against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import fingerprints, mixing

ROWS = [(5, "abcdefghij" * 30), (4, "abcdefghij" * 30), (3, "abcdefghij" * 20 + "Z" * 100), (2, None), (1, ""), (0, "é🙂x"), (9, "q"), (9, "p" * 50), (None, "last"), (-3, "w" * 3000)]


def test_spans_and_extensions():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abé🙂"), rng.integers(0, 60))) for _ in range(30)] + ["ab" * 30, "ab" * 20 + "x"]
    h = fingerprints.PrefixHashes(texts)
    for _ in range(500):
        a, b = rng.integers(0, len(texts), 2)
        i, j = rng.integers(0, len(texts[a]) + 1), rng.integers(0, len(texts[b]) + 1)
        n = rng.integers(0, min(len(texts[a]) - i, len(texts[b]) - j) + 1)
        one = lambda *x: [np.array([v]) for v in x]
        assert h.equal(*one(a, i, b, j, n))[0] == (texts[a][i : i + n] == texts[b][j : j + n])
        want = 0
        while i + want < len(texts[a]) and j + want < len(texts[b]) and texts[a][i + want] == texts[b][j + want]:
            want += 1
        assert h.extension(*one(a, i, b, j))[0] == want


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edited_texts_and_next_documents(spark, ranges):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, n_chars string").repartition(3)
    got = fingerprints.fingerprints(docs, ranges).collect()
    ordered = sorted(((i, t or "") for i, t in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(got) == len(ROWS)
    prints = {}
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = next(r for r in got if r["doc_id"] == i and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["near_edited"] == 1) == (t == edited)
        assert (r["near_next"] == 1) == (t == after)
        assert 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.fingerprints(docs.where("false")).count() == 0


def test_likeness_follows_the_shared_part(spark):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("abcdefgh"), 3000))
    for share in (0.2, 0.5, 0.9):
        other = base[: int(3000 * share)] + "".join(rng.choice(list("stuvw"), 3000 - int(3000 * share)))
        r = fingerprints.compare_with_next([1, 2], [base, other]).to_pylist()[0]
        assert share - 0.13 <= r["near_next"] <= share + 1e-9


def plain_likeness(a, b):
    """The definition on the texts themselves."""
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    lengths = [0, *(x for x in fingerprints.grid(long).tolist() if x <= short)]
    head = max(x for x in lengths if a[:x] == b[:x])
    tail = max(x for x in lengths if a[len(a) - x :] == b[len(b) - x :])
    starts = sum(y - x for x, y in zip(lengths, lengths[1:]) if a[x:y] == b[x:y])
    ends = sum(y - x for x, y in zip(lengths, lengths[1:]) if a[len(a) - y : len(a) - x] == b[len(b) - y : len(b) - x])
    return min(max(starts, ends, min(head + tail, short)) / max(long, 1), 1 - 1 / (long + 1))


def common_in_order(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, t[j + 1] = t[j + 1], last + 1 if x == y else max(t[j + 1], t[j])
    return t[-1]


def test_likeness_against_the_texts():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice(list("abé🙂c"), rng.integers(0, 200)))
        edits = list(base)
        for _ in range(rng.integers(0, 5)):
            k = rng.integers(0, len(edits) + 1)
            edits[k : k + rng.integers(0, 10)] = list(rng.choice(list("abxyz"), rng.integers(0, 10)))
        texts += [base, "".join(edits)]
    hashes = fingerprints.PrefixHashes(texts)
    every = np.arange(len(texts))
    prints = fingerprints.Fingerprints(hashes.size, lambda k, n: hashes.prefix(k, every[:, None], n), int(hashes.size.max()))
    a, b = rng.integers(0, len(texts), 400), rng.integers(0, len(texts), 400)
    a[:120], b[:120] = every[:-1].tolist() + [0], every[1:].tolist() + [0]
    got = fingerprints.likeness(prints.take(a), prints.take(b))
    assert got.tolist() == pytest.approx([plain_likeness(texts[i], texts[j]) for i, j in zip(a, b, strict=True)])
    assert len(set(zip(texts, prints.strings(), strict=True))) == len(set(texts)) == len(set(prints.strings()))

    def ends(x, y):
        n = min(len(x), len(y))
        head = next((k for k in range(n) if x[k] != y[k]), n)
        tail = next((k for k in range(n) if x[-1 - k] != y[-1 - k]), n)
        return min(head + tail, n)

    for r, x, y in zip(fingerprints.compare_with_next(every.tolist(), texts).to_pylist(), texts, texts[1:], strict=False):
        edited = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        for near, other in ((r["near_next"], y), (r["near_edited"], edited)):
            longer = max(len(x), len(other))
            if x == other:
                assert near == 1
            else:
                low = max(plain_likeness(x, other), min(ends(x, other) / max(longer, 1), 1 - 1 / (longer + 1)))
                assert low - 1e-9 <= near <= max(common_in_order(x, other) / max(longer, 1), plain_likeness(x, other)) + 1e-9


def plain_rake(cells, targets, rounds):
    share = {c: m / sum(cells.values()) for c, m in cells.items()}
    for _ in range(rounds):
        for k, target in enumerate(targets):
            now = {}
            for c, s in share.items():
                now[c[k]] = now.get(c[k], 0) + s
            share = {c: s * target[c[k]] / now[c[k]] if now[c[k]] else 0.0 for c, s in share.items()}
    return share


def test_raking_and_calibration(spark):
    cells = {("a", "en", "x"): 100.0, ("a", "de", "x"): 30.0, ("b", "en", "y"): 50.0, ("b", "de", "x"): 20.0, (None, "en", "x"): 10.0}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, _mass double")
    targets = {"source": 0.5, "lang": {"en": 0.5, "de": 0.5, "fr": 0.3}, "topic": {"y": 0.3}}
    fitted = mixing.rake(frame, targets, 30)
    roots = {s: sum(m for c, m in cells.items() if c[0] == s) ** 0.5 for s in ("a", "b", None)}
    want = plain_rake(cells, [{s: r / sum(roots.values()) for s, r in roots.items()}, {"en": 0.5, "de": 0.5}, {"y": 0.3, "x": 0.7}], 30)
    got = {(r["source"], r["lang"], r["topic"]): r for r in mixing.calibrate(fitted, 0.5).collect()}
    assert {c: r["_share"] for c, r in got.items()} == pytest.approx(want)
    off = max(abs(sum(s for c, s in want.items() if c[k] == v) - share) for k, target in enumerate([{s: r / sum(roots.values()) for s, r in roots.items()}, {"en": 0.5, "de": 0.5}, {"y": 0.3, "x": 0.7}]) for v, share in target.items())
    assert all(r["_error"] == pytest.approx(off, abs=1e-12) for r in got.values())
    few = mixing.rake(frame, targets, 1).first()["_error"]
    assert few > got["a", "en", "x"]["_error"]
    assert sum(r["_p"] * r["_mass"] for r in got.values()) == pytest.approx(105.0)
    level = [r["_p"] * r["_mass"] / r["_share"] for r in got.values() if r["_p"] < 1]
    assert level == pytest.approx([level[0]] * len(level))
    assert all(r["_mass"] / r["_share"] <= level[0] + 1e-9 for r in got.values() if r["_p"] == 1)


def test_topics_from_a_column(spark):
    rows = [(k, "w " * 10, "en", "s", ["sport", "law", None][k % 3]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `my topic` string")
    got = mixing.mixed(docs, topic="my topic", fraction=0.5, targets={**mixing.TARGETS, "topic": {"sport": 0.5}}).collect()
    assert {r["_topic"] for r in got} == {"sport", "law", None}
    weight = {t: next(r["_weight"] for r in got if r["_topic"] == t) for t in ("sport", "law", None)}
    assert weight == pytest.approx({"sport": 1.5, "law": 0.75, None: 0.75})


def test_mixture_of_odd_rows(spark):
    rows = [(k, "w " * (k % 30), ["en", "de", None][k % 3], f"s{k % 4}") for k in range(600)] + [(700, None, None, None), (701, "", "en", "s1"), (5, "again", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"topic": F.lit(1), "_p": F.lit("own"), "_row": F.lit(2)}).repartition(3)
    out = mixing.mixed(docs, fraction=0.5)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r["_n_words"] == len((r["text"] or "").split()) for r in got)
    assert sum(r["_n_words"] for r in got if r["_selected"]) == pytest.approx(0.5 * sum(r["_n_words"] for r in got), rel=0.15)
    assert mixing.sampled(docs).columns == docs.columns
    assert {r["_p"] for r in mixing.sampled(docs).collect()} == {"own"}
    assert mixing.mixed(docs.where("false")).count() == 0
    again = {(r["doc_id"], r["text"]): r["_selected"] for r in mixing.mixed(docs, fraction=0.5).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["_selected"] for r in got)


def test_legal_texts_are_found_in_any_case(spark):
    words = ["license ", "LICENSE ", "licence ", "Licence ", "licenced ", "Licensed ", "CopyRight", "COPYRIGHT", "Copyright", "licenses ", "license", "sublicense ", "é licence ", "KLicen", "copy right", "silicone "]
    texts = [before + w + behind for w in words for before in ("", "under the ", "a | b (555) 123-4567 ") for behind in ("", "terms")]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.topic_of(F.col("text")).alias("topic")).collect()
    for r in got:
        legal = re.search(r"\blicen[sc]ed? |copyright", r["text"], re.IGNORECASE | re.ASCII) is not None
        assert (r["topic"] == "legal") == legal, r
    assert sum(r["topic"] == "legal" for r in got) > len(got) / 3


def test_unnamed_languages_keep_their_share(spark):
    rows = [(k, "w " * 20, ["en", "de", "fr", "es", "it", None][k % 6], f"s{k % 2}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mixed(docs, fraction=0.3).collect()
    for lang in ("it", None):
        of = [r for r in got if r["lang"] == lang]
        assert all(r["_p"] > 0 for r in of)
        assert sum(r["_p"] for r in of) / sum(r["_p"] for r in got) == pytest.approx(1 / 6, rel=1e-6)
        assert any(r["_selected"] for r in of)
    shares = {lang: sum(r["_weight"] for r in got if r["lang"] == lang) / len(got) for lang in ("en", "de")}
    assert shares == pytest.approx({"en": 0.4 * 2 / 3, "de": 0.2 * 2 / 3})


@pytest.mark.parametrize("n", [200, 1000, 5000])
def test_near_copies_with_moved_and_replaced_words_are_alike(n):
    rng = np.random.default_rng(n)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    words = [word() for _ in range(n)]
    moved = [*words[: n // 20], word(), *words[n // 20 : n - n // 20], word(), *words[n - n // 20 :]]
    replaced = ["".join(rng.choice(list("qrstuvwxyz"), len(w))) if k % 20 == 10 else w for k, w in enumerate(words)]
    dropped = words[: n // 3] + words[n // 2 :]
    other = [word() for _ in range(n)]
    near = lambda a, b: fingerprints.compare_with_next([1, 2], [" ".join(a), " ".join(b)]).to_pylist()[0]["near_next"]
    assert 0.95 < near(words, moved) < 1
    assert 0.8 < near(words, replaced) < 0.97
    assert 0.75 < near(words, dropped) < 0.9
    assert 0.75 < near(dropped, words) < 0.9
    assert near(words, other) < 0.1
    assert near(words, words) == 1
