"""An interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted arrays that workers map.

Counting takes three shuffles, each of one row per task and part with packed ascending keys and counts:

1. *words*: the 64-bit hashes of all training tokens with their counts, in parts by ranges of the hash. A word's id is
   its rank among all hashes. Texts end with one end token; a start token stands before the first word as context only.
2. *bigrams*: keys ``id(context) << 32 | id(word)`` with counts, in parts by ranges of the key. The bounds come from the
   words' counts, so a frequent context (or one that a third of all rows share) is spread over parts by its next words.
3. *statistics*: for each word the number of distinct words before it (its continuation count) and, as a context, how
   many bigrams occur once, twice and more often, in the parts of the words.

Discounts follow Chen and Goodman from the counts of counts of each order; where a small corpus has no count of one or
two, 0.5, 1 and 1.5 are taken. With ``c`` a bigram's count, ``T`` its context's and ``B`` the number of distinct bigrams:

    p(w | v) = max(c - D(c), 0) / T + (D1 n1 + D2 n2 + D3 n3)(v) / T * p(w)
    p(w)     = max(a - d(a), 0) / B + (d1 m1 + d2 m2 + d3 m3) / B / (V + 1)

so words outside of training share the lower order's mass with the others, and every context's probabilities add up to
one over the vocabulary and one unknown word. Contexts outside of training use ``p(w)`` alone.

Scoring reads each text once; a worker maps the arrays and looks up the distinct keys of a slice of texts in order.

Counts of bigrams have four bytes each, or eight in parts where one needs it; more than 2**32 distinct words raise.

Defined cases: null texts are empty and have the end token alone; null ids count as the empty text in the split;
repeated rows count as often as they occur; without any training row all scores come from the unknown word's
probability 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, claim, documents, keeps, partitions, text_slices, word_hashes, words, work_path
from sluice.llm.shared_arrays import counted, from_planes, map_part, merged, planes, write_part

#: Hashes of the start and the end token; no word's hash is taken for them.
START, END = np.uint64(1), np.uint64(2)

WORD = np.dtype([("count", "<i8"), ("before", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])

_PART = "part int, keys binary, counts binary, more binary"
_NAMES = ["part", "keys", "counts", "more"]


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text as start, words, end; and the place of each start, then the length."""
    offsets, coded = words(column)
    own = word_hashes(coded)
    own[own <= END] += np.uint64(3)
    sizes = np.diff(offsets) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[starts[:-1]], out[starts[1:] - 1], out[inner] = START, END, own
    return out, starts


def _ints(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


def _rows(parts: list[tuple[int, np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([p for p, *_ in parts], pa.int32()), pa.array([planes(k) for _, k, *_ in parts], pa.binary()), pa.array([_ints(c) for *_, c, _ in parts], pa.binary()), pa.array([m for *_, m in parts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _dealt(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """Ascending keys by part: part i has those from bounds[i] on."""
    cuts = [0, *np.searchsorted(keys, bounds[1:]).tolist(), len(keys)]
    for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            yield part, keys[a:b], counts[a:b], b""


#: Keys that a task gathers before it counts them.
GATHERED = 4_000_000


def _tally(keys_of, bounds_of):
    """A mapper: keys of all texts, counted in runs of GATHERED, and dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("model")
        held: list[np.ndarray] = []
        bounds = None
        for batch in batches:
            for part in text_slices(batch):
                held.append(keys_of(part.column("text")))
                bounds = bounds_of() if bounds is None else bounds
                if sum(map(len, held)) >= GATHERED:
                    yield _rows(list(_dealt(*counted(np.concatenate(held)), bounds)))
                    held = []
        if held and sum(map(len, held)):
            yield _rows(list(_dealt(*counted(np.concatenate(held)), bounds_of() if bounds is None else bounds)))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """A part's keys and counts, merged as they come so that little more than the result is held."""
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = out.setdefault(part, [])
            own.append((from_planes(keys, np.uint64), np.frombuffer(counts, "<u4")))
            if sum(len(k) for k, _ in own[1:]) > max(2_000_000, len(own[0][0])):
                out[part] = [merged([k for k, _ in own], [c for _, c in own])]
    return {part: merged([k for k, _ in own], [c for _, c in own]) for part, own in out.items()}


@dataclass
class Model:
    """Where the arrays are, the bounds of their parts, and the numbers that all workers need."""

    folder: str
    parts: int
    first_id: list[int] = field(default_factory=list)
    gram_bounds: np.ndarray | None = None
    gram_parts: frozenset[int] = frozenset()
    tokens: int = 0
    types: int = 0
    grams: int = 0
    discounts: tuple = ((0.5, 1.0, 1.5), (0.5, 1.0, 1.5))
    rest: float = 1.0

    def maps(self) -> _Maps:
        if self.folder not in _MAPS:
            _MAPS.clear()
            _MAPS[self.folder] = _Maps(self)
        # Workers have the arrays from earlier steps, which knew less of the model.
        _MAPS[self.folder].model = self
        return _MAPS[self.folder]


_MAPS: dict[str, _Maps] = {}
keeps("model", _MAPS.clear)


def _hash_bounds(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


class _Maps:
    """The arrays of a model in this process, each part mapped when it is first used."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.bounds = _hash_bounds(model.parts)

    def part(self, kind: str, number: int, dtype) -> np.ndarray:
        if (kind, number) not in self.known:
            self.known[kind, number] = map_part(self.model.folder, f"{kind}-{number}", dtype)
        return self.known[kind, number]

    def ids(self, distinct: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes, -1 for those outside of training."""
        out = np.full(len(distinct), -1, np.int64)
        cuts = [0, *np.searchsorted(distinct, self.bounds[1:]).tolist(), len(distinct)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = self.part("hashes", p, "<u8")
            if a < b and len(own):
                at = np.minimum(np.searchsorted(own, distinct[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == distinct[a:b], at + self.model.first_id[p], -1)
        return out

    def words(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ascending ids."""
        out = np.zeros(len(ids), WORD)
        cuts = [*np.searchsorted(ids, self.model.first_id).tolist(), len(ids)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                out[a:b] = self.part("words", p, WORD)[ids[a:b] - self.model.first_id[p]]
        return out

    def counts(self, distinct: np.ndarray) -> np.ndarray:
        """Counts of ascending bigram keys."""
        out = np.zeros(len(distinct), np.int64)
        cuts = [0, *np.searchsorted(distinct, self.model.gram_bounds[1:]).tolist(), len(distinct)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = self.part("grams", p, "<u8") if a < b and p in self.model.gram_parts else ()
            if len(own):
                at = np.minimum(np.searchsorted(own, distinct[a:b]), len(own) - 1)
                out[a:b] = np.where(own[at] == distinct[a:b], self.gram_counts(p)[at], 0)
        return out

    def gram_counts(self, number: int) -> np.ndarray:
        """A part's counts, in eight bytes each where four don't hold one of them."""
        raw = self.part("gram-counts", number, "u1")
        return raw.view("<u8" if len(raw) == 8 * len(self.part("grams", number, "<u8")) else "<u4")


def _by_value(values: np.ndarray, look) -> np.ndarray:
    """look() over the ascending distinct values, dealt back to all values."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.empty(0, bool)
    found = look(ranked[new])
    out = np.empty(len(values), found.dtype)
    out[order] = found[np.cumsum(new) - 1]
    return out


def _word_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (hashes, counts) in _gather(batches).items():
            write_part(folder, f"hashes-{part}", hashes.astype("<u8"))
            write_part(folder, f"word-counts-{part}", counts.astype("<i8"))
            words_only = hashes != START
            at, ahead, count = _marks(counts)
            lists = {k: pa.array([v], pa.list_(pa.int64())) for k, v in (("at", at), ("ahead", ahead), ("count", count))}
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [len(hashes)], "all": [int(counts.sum())], "tokens": [int(counts[words_only].sum())], "types": [int(words_only.sum())], **lists})

    return run


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each, or in eight where one of them needs it."""
    return counts.astype("<u8" if len(counts) and counts.max() >= 1 << 32 else "<u4")


#: Places of a part's words that are known to the driver.
MARKS = 64


def _marks(counts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Of a part's words by order, up to MARKS that cut its tokens evenly: places, tokens ahead, and counts."""
    ends = np.cumsum(counts)
    at = np.unique(np.searchsorted(ends, np.arange(MARKS) * (int(ends[-1]) // MARKS), side="right"))
    return at.tolist(), (ends[at] - counts[at]).tolist(), counts[at].tolist()


def _gram_bounds(marks: list[tuple[int, int, int]], tokens: int, parts: int) -> np.ndarray:
    """Keys that split all bigrams into parts of like mass, taking word and context as independent.

    marks: ids, tokens ahead and counts of words, MARKS for each part of them. Bounds only deal the work out.
    """
    if not marks:
        return np.zeros(parts, np.uint64)
    ids, ahead, counts = (np.array(x, np.int64) for x in zip(*marks, strict=True))

    def place(goal: float) -> tuple[int, float]:
        """The word where so many tokens lie ahead, and how far into it."""
        k = max(0, int(np.searchsorted(ahead, goal, side="right")) - 1)
        within = (goal - int(ahead[k])) / max(1, int(counts[k]))
        return (int(ids[k]), within) if within < 1 else (int(ids[k]) + 1, 0.0)

    out = [0]
    for i in range(1, parts):
        context, within = place(tokens * i / parts)
        out.append(context << 32 | place(within * tokens)[0])
    return np.maximum.accumulate(np.array(out, np.uint64))


_STATISTICS = ("before", "n1", "n2", "n3")


def _gram_part(model: Model):
    """Writes a part of the bigrams; gives its statistics by word id, packed as ids and four numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (keys, counts) in _gather(batches).items():
            write_part(model.folder, f"grams-{part}", keys.astype("<u8"))
            write_part(model.folder, f"gram-counts-{part}", narrow(counts))
            word, context = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
            found: dict[str, tuple[np.ndarray, np.ndarray]] = {"before": counted(word.copy())}
            for name, which in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts > 2)):
                found[name] = counted(context[which].copy())
            ids = np.unique(np.concatenate([k for k, _ in found.values()]))
            table = np.zeros((4, len(ids)), "<u4")
            for row, (k, n) in enumerate(found.values()):
                table[row, np.searchsorted(ids, k)] = n
            cuts = np.append(np.searchsorted(ids, np.array(model.first_id, np.uint64)), len(ids)).tolist()
            rows = [(p, ids[a:b], table[0, a:b], table[1:, a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            of = np.bincount(np.minimum(counts, 5), minlength=6)[1:5] if len(counts) else np.zeros(4, int)
            rows.append((-1, np.empty(0, np.uint64), np.empty(0, np.uint32), np.array([part, len(keys), *of], "<i8").tobytes()))
            yield _rows(rows)

    return run


def _statistics_part(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, keys, counts, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part not in tables:
                    own = map_part(model.folder, f"word-counts-{part}", "<i8")
                    tables[part] = np.zeros(len(own), WORD)
                    tables[part]["count"] = own
                at = (from_planes(keys, np.uint64) - np.uint64(model.first_id[part])).astype(np.int64)
                table = tables[part]
                table["before"][at] += np.frombuffer(counts, "<u4")
                for name, n in zip(_STATISTICS[1:], np.frombuffer(more, "<u4").reshape(3, -1), strict=True):
                    table[name][at] += n
        for part, table in tables.items():
            write_part(model.folder, f"words-{part}", table)
            of = np.bincount(np.minimum(table["before"], 5), minlength=6)[1:5]
            more = int((table["before"] > 2).sum())
            yield pa.RecordBatch.from_pydict({"m1": [int(of[0])], "m2": [int(of[1])], "m3": [int(of[2])], "m4": [int(of[3])], "over": [more]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    own = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(own, 1))


def train(docs: DataFrame, text: str = "text", parts: int | None = None) -> Model:
    """Counts all rows of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = parts or partitions(spark)
    folder = work_path(spark, "kneser-ney")
    model = Model(folder, n)
    rows = docs.select(F.col(text).alias("text"))
    by_hash = rows.mapInArrow(_tally(lambda column: _sequence(column)[0], lambda: _hash_bounds(n)), _PART)
    found = {r["part"]: r for r in by_hash.repartitionById(n, F.col("part")).mapInArrow(_word_part(folder), "part int, n long, all long, tokens long, types long, at array<long>, ahead array<long>, count array<long>").collect()}  # one row of 3 x MARKS numbers per part
    for p in range(n):
        if p not in found:
            write_part(folder, f"hashes-{p}", np.empty(0, "<u8"))
            write_part(folder, f"word-counts-{p}", np.empty(0, "<i8"))
        model.first_id.append((model.first_id[-1] + (found[p - 1]["n"] if p - 1 in found else 0)) if p else 0)
    size = sum(r["n"] for r in found.values())
    if size >= 1 << 32:  # ids have 32 bits in a bigram's key
        raise ValueError("more than 2**32 distinct words")
    model.tokens, model.types = (sum(r[k] for r in found.values()) for k in ("tokens", "types"))
    if not size:
        return model
    marks, before = [], 0
    for p in sorted(found):
        marks += [(model.first_id[p] + i, before + a, c) for i, a, c in zip(found[p]["at"], found[p]["ahead"], found[p]["count"], strict=True)]
        before += found[p]["all"]
    model.gram_bounds = _gram_bounds(marks, before, n)
    maps_of = model.maps

    def grams(column: pa.Array) -> np.ndarray:
        hashes, starts = _sequence(column)
        ids = _by_value(hashes, maps_of().ids).astype(np.uint64)
        last = np.zeros(len(ids), bool)
        last[starts[1:] - 1] = True
        return (ids[:-1] << np.uint64(32) | ids[1:])[~last[:-1]]

    bounds = model.gram_bounds
    by_gram = rows.mapInArrow(_tally(grams, lambda: bounds), _PART)
    statistics = by_gram.repartitionById(n, F.col("part")).mapInArrow(_gram_part(model), _PART)
    path = work_path(spark, "kneser-ney-statistics")
    statistics.write.parquet(path)
    statistics = spark.read.schema(_PART).parquet(path)
    told = [np.frombuffer(r["more"], "<i8") for r in statistics.where("part < 0").select("more").collect()]  # one row per part
    model.gram_parts = frozenset(int(x[0]) for x in told)
    totals = sum(x[1:] for x in told)
    model.grams = int(totals[0])
    orders = statistics.where("part >= 0").repartitionById(n, F.col("part")).mapInArrow(_statistics_part(model), "m1 long, m2 long, m3 long, m4 long, over long")
    m = orders.groupBy().sum().first()
    low, high = discounts(*m[:4]), discounts(*totals[1:].tolist())
    model.discounts = low, high
    model.rest = (low[0] * m[0] + low[1] * m[1] + low[2] * m[4]) / model.grams / (model.types + 1)
    return model


def _discount(counts: np.ndarray, of: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *of])[np.minimum(counts, 3)]


def score_texts(model: Model, column: pa.Array) -> dict[str, np.ndarray]:
    """Per text: number of tokens, of known tokens, add-one and model log10 probabilities."""
    hashes, starts = _sequence(column)
    last = np.zeros(len(hashes), bool)
    last[starts[1:] - 1] = True
    first = starts[:-1] - np.arange(len(starts) - 1)
    n = np.diff(starts) - 1
    if not model.types:
        zero = np.zeros(len(n))
        return {"n_tokens": n, "n_known": zero.astype(np.int64), "base_score": zero, "score": zero}
    maps, (low, high) = model.maps(), model.discounts
    ids = _by_value(hashes, maps.ids)
    rows = _by_value(ids, lambda distinct: maps.words(np.maximum(distinct, 0)))
    context, word = ids[:-1][~last[:-1]], ids[1:][~last[:-1]]
    v, w = rows[:-1][~last[:-1]], rows[1:][~last[:-1]]
    known, seen = word >= 0, context >= 0
    count = np.where(known, w["count"], 0)
    before = np.where(known, w["before"], 0).astype(np.int64)
    lower = np.maximum(before - _discount(before, low), 0) / model.grams + model.rest
    pairs = known & seen
    c = np.zeros(len(word), np.int64)
    c[pairs] = _by_value((context[pairs] << 32 | word[pairs]).astype(np.uint64), maps.counts)
    total = np.where(seen, v["count"], 1)
    freed = high[0] * v["n1"] + high[1] * v["n2"] + high[2] * v["n3"]
    p = np.where(seen, np.maximum(c - _discount(c, high), 0) / total + freed / total * lower, lower)
    base = np.log10((count + 1) / (model.tokens + model.types + 1))
    add = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)  # noqa: E731  every text has a token
    return {"n_tokens": n, "n_known": add((count > 0).astype(np.int64)).astype(np.int64), "base_score": add(base), "score": add(np.log10(p))}


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("model")
        for batch in batches:
            for part in text_slices(batch):
                found = score_texts(model, part.column("text"))
                tokens = pa.array(np.full(part.num_rows, model.tokens, np.int64))
                columns = [part.column("doc_id"), part.column("held_out"), pa.array(found["n_tokens"]), pa.array(found["n_known"]), tokens, pa.array(found["base_score"]), pa.array(found["score"])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def perplexity_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod folds isn't held_out and scores all."""
    bounded_batches(docs.sparkSession)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(own.cast("binary")) % folds == held_out).alias("held_out"))
    model = train(rows.where(~F.col("held_out")))
    return rows.mapInArrow(_score(model), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_scores(documents(spark, sf_dir))
