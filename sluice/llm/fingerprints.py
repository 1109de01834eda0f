"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for many texts at once, the running sums of ``(code point + 1) * base**place`` under the prime
2**31 - 1 for two bases. Any span's hash comes from two of its entries; spans at different places are compared after
multiplication by a power; the longest common extension of two places is found by binary search.

A fingerprint has the text's number of code points, the whole text's hash, and the 62-bit hashes (both bases) of its
prefixes and of its suffixes at the lengths of ``GRID`` (1, 2, 3 and so on, then in steps of an eighth). Its size grows with
the logarithm of the text's length. Two fingerprints tell how much of both texts agrees when they are aligned at their
starts or at their ends: the longest grid lengths at which prefixes and suffixes agree are found by binary search, and
between neighbouring grid lengths the spans' hashes, which are differences of the prefixes', are equal or not.
``likeness`` is the agreeing part of the longer text, and 1 exactly when lengths and whole hashes are equal.

``near_edited`` and ``near_next`` are the likeness of two fingerprints; where walking the two texts, which are at hand, side
by side finds more, that counts. What starts and ends have in common is found by binary search over the prefix arrays.
A walk follows the longest common extension in the same way; at an edit it goes on at an anchor (a span of ``ANCHOR`` code points, chosen by its hash, wherever it stands) that
both texts have further on, of the next ``AHEAD`` the one that skips least. What it finds is common to both texts in one
order, so it is never too much.

Documents are dealt out by ranges of doc_id whose bounds are ids that occur; a range's last document needs the first
one of the next range, so each bound's text is sent there a second time. Every text thus crosses one shuffle.

Defined cases: null texts are empty; two empty texts are alike (1), an empty and another one not at all (0); a null
doc_id comes after all others; repeated ids follow each other by text; a single document is its own next one; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import GOLD, bounded_batches, claim, documents, mix, partitions, text_slices

P = np.uint64((1 << 31) - 1)
#: Two bases under P.
BASES = (1_103_515_245, 1_566_083_941)
#: Bytes of text whose prefix arrays are held at once.
SLICE = 2 << 20
#: Code points of an anchor; one place of so many has one; those looked at for the way past an edit.
ANCHOR, EVERY, AHEAD = 16, 4, 16


def grid(longest: int) -> np.ndarray:
    """Lengths at which prefixes and suffixes are hashed, up to longest."""
    out, x = [], 1
    while x <= longest:
        out.append(x)
        x = max(x + 1, x * 9 // 8)
    return np.array(out, np.int64)


class _Powers:
    """Powers of a base under P, as far as they were asked for."""

    def __init__(self, base: int):
        self.known = np.array([1, base], np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) <= n:
            top = self.known[-1] * self.known[1] % P
            self.known = np.concatenate([self.known, self.known * top % P])
        return self.known


_POWERS = [_Powers(b) for b in BASES]
_INVERSE = [_Powers(pow(b, -1, int(P))) for b in BASES]


class PrefixHashes:
    """Prefix arrays of many texts; all methods take arrays of text numbers and places."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        place = np.arange(len(code)) - np.repeat(self.start, self.size)
        longest = int(self.size.max(initial=0))
        self.sums = []
        for powers in _POWERS:
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(code * powers.upto(longest)[place] % P, dtype=np.uint64)]))

    def prefix(self, k: int, text: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The hash, under base k, of a text's first n code points."""
        a = self.start[text]
        return (self.sums[k][a + n] - self.sums[k][a]) % P

    def span(self, k: int, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The hash of text[start:stop], as if it stood at the text's beginning."""
        a = self.start[text]
        inverse = _INVERSE[k].upto(int(np.max(start, initial=0)))
        return (self.sums[k][a + stop] - self.sums[k][a + start]) % P * inverse[start] % P

    def equal(self, text_a, start_a, text_b, start_b, n) -> np.ndarray:
        """Whether spans of n code points are equal."""
        return np.logical_and.reduce([self.span(k, text_a, start_a, start_a + n) == self.span(k, text_b, start_b, start_b + n) for k in range(2)])

    def extension(self, text_a, start_a, text_b, start_b) -> np.ndarray:
        """How many code points agree from the two places on."""
        low = np.zeros(len(text_a), np.int64)
        high = np.minimum(self.size[text_a] - start_a, self.size[text_b] - start_b)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(text_a, start_a, text_b, start_b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def tail(self, text_a, text_b) -> np.ndarray:
        """How many code points agree up to the ends of two texts."""
        low, high = np.zeros(len(text_a), np.int64), np.minimum(self.size[text_a], self.size[text_b])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(text_a, self.size[text_a] - middle, text_b, self.size[text_b] - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, places and hashes of the spans of ANCHOR code points that their hashes choose, in order."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
        ends = self.start + self.size
        for low in range(0, len(self.sums[0]) - 1, 1 << 20):
            at = np.arange(low, min(low + (1 << 20), len(self.sums[0]) - 1))
            text = np.searchsorted(ends, at, side="right")
            whole = at + ANCHOR <= ends[text]
            at, text = at[whole], text[whole]
            place = at - self.start[text]
            value = self.span(0, text, place, place + ANCHOR)
            chosen = mix(value * GOLD) % np.uint64(EVERY) == 0
            out.append((text[chosen], place[chosen], value[chosen]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def walked(self, every: int = 1) -> np.ndarray:
        """For each text but the last, the code points it has in common, in one order, with the next one; for every second one with 2."""
        m = len(self.size) - 1
        pair, agree = np.arange(0, m, every), np.zeros(m, np.int64)
        i, j, following = (np.zeros(len(pair), np.int64) for _ in range(3))
        text, place, value = self.anchors()
        key = text.astype(np.uint64) << np.uint64(32) | value
        # The next texts' anchors by pair and hash, then place; of a text's own, those that the next one has.
        later = text > 0
        known, number = np.unique(key[later] - np.uint64(1 << 32), return_inverse=True)
        theirs = np.sort(number.astype(np.int64) << 40 | place[later])
        own = np.searchsorted(known, key)
        has = own < len(known)
        has[has] = known[own[has]] == key[has]
        text, place, own = text[has], place[has], own[has].astype(np.int64)
        order, stop = text << 40 | place, np.searchsorted(text, np.arange(m), side="right")
        while len(pair):
            n = self.extension(pair, i, pair + 1, j)
            agree[pair] += n
            i, j = i + n, j + n
            following = np.maximum(following, np.searchsorted(order, pair << 40 | i))
            on = (following < stop[pair]) & (j < self.size[pair + 1])
            pair, i, j, following = pair[on], i[on], j[on], following[on]
            if not len(pair):
                break
            ahead = following[:, None] + np.arange(AHEAD)
            there = ahead < stop[pair][:, None]
            ahead = np.minimum(ahead, len(own) - 1)
            k = np.searchsorted(theirs, own[ahead] << 40 | j[:, None])
            there &= k < len(theirs)
            match = theirs[np.minimum(k, len(theirs) - 1)]
            there &= match >> 40 == own[ahead]
            to_i, to_j = place[ahead], match & ((1 << 40) - 1)
            skipped = np.where(there, to_i - i[:, None] + to_j - j[:, None], 1 << 41)
            rows, best = np.arange(len(pair)), skipped.argmin(1)
            found = there.any(1)
            i, j = np.where(found, to_i[rows, best], i), np.where(found, to_j[rows, best], j)
            following = following + np.where(found, best + 1, AHEAD)
        return agree[::every]


class Fingerprints:
    """Fingerprints of many texts as arrays: sizes, whole hashes, and under each base the prefix and suffix hashes at the grid's lengths."""

    def __init__(self, size: np.ndarray, prefix_at, longest: int):
        """prefix_at(k, n): hashes of the prefixes of n code points; n has a row for every text."""
        self.grid, self.size = grid(longest), size
        whole = [prefix_at(k, size[:, None]) for k in range(2)]
        self.whole = (whole[0] << np.uint64(31) | whole[1])[:, 0]
        self.there = self.grid[None, :] <= size[:, None]
        n = np.where(self.there, self.grid[None, :], 0)
        rest = size[:, None] - n
        self.prefix, self.suffix = [], []
        for k in range(2):
            self.prefix.append(np.where(self.there, prefix_at(k, n), 0))
            self.suffix.append(np.where(self.there, (whole[k] + P - prefix_at(k, rest)) % P * _INVERSE[k].upto(longest)[rest] % P, 0))

    def strings(self) -> list[str]:
        """Size, whole hash, and the hashes of prefixes and of suffixes, eight bytes each, in base 64."""
        counts, width = self.there.sum(1).tolist(), 8 * len(self.grid)
        both = [(x[0] << np.uint64(31) | x[1]).astype(">u8").tobytes() for x in (self.prefix, self.suffix)]
        shown = lambda x, i, c: base64.b64encode(x[i * width : i * width + 8 * c]).decode()
        return [f"{n}.{w:016x}.{shown(both[0], i, c)}.{shown(both[1], i, c)}" for i, (n, w, c) in enumerate(zip(self.size.tolist(), self.whole.tolist(), counts, strict=True))]

    def take(self, rows: np.ndarray) -> Fingerprints:
        out = object.__new__(Fingerprints)
        out.grid, out.size, out.whole, out.there = self.grid, self.size[rows], self.whole[rows], self.there[rows]
        out.prefix, out.suffix = ([x[rows] for x in y] for y in (self.prefix, self.suffix))
        return out


def _longest(a: list[np.ndarray], b: list[np.ndarray], both: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The longest grid length at which hashes agree, by binary search: a prefix of equal prefixes is equal."""
    rows = np.arange(len(both))
    low, high = np.zeros(len(both), np.int64), both.sum(1)
    while (low < high).any():
        middle = (low + high + 1) // 2
        at = np.maximum(middle - 1, 0)
        same = (a[0][rows, at] == b[0][rows, at]) & (a[1][rows, at] == b[1][rows, at]) | (middle == 0)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return np.concatenate([[0], lengths])[low]


def _spans(a: list[np.ndarray], b: list[np.ndarray], both: np.ndarray, lengths: np.ndarray, at_end: bool) -> np.ndarray:
    """Code points in agreeing spans between neighbouring grid lengths."""
    zero = np.zeros((len(both), 1), np.uint64)
    steps = np.diff(np.concatenate([[0], lengths]))
    same = both.copy()
    for k in range(2):
        # A longer suffix is new code points and then the shorter one, moved by their number.
        power = _POWERS[k].upto(int(steps.max(initial=1)))[steps] if at_end else np.ones(len(steps), np.uint64)
        span = lambda x: (x + P - np.concatenate([zero, x[:, :-1]], 1) * power % P) % P  # noqa: B023, E731
        same &= span(a[k]) == span(b[k])
    return same @ steps


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """0 to 1 for the rows of both, whose grids are one."""
    both = a.there & b.there
    longer = np.maximum(a.size, b.size)
    head, tail = _longest(a.prefix, b.prefix, both, a.grid), _longest(a.suffix, b.suffix, both, a.grid)
    spans = np.maximum(_spans(a.prefix, b.prefix, both, a.grid, False), _spans(a.suffix, b.suffix, both, a.grid, True))
    agree = np.maximum(spans, np.minimum(head + tail, np.minimum(a.size, b.size)))
    same = (a.size == b.size) & (a.whole == b.whole)
    return np.where(same, 1.0, np.minimum(agree / np.maximum(longer, 1), 1 - 1 / (longer + 1.0)))


def _in_common(hashes: PrefixHashes, every: int) -> np.ndarray:
    """Code points that each (every second) text shares in one order with the one after it, by a walk or at both ends."""
    a = np.arange(0, len(hashes.size) - 1, every)
    zero = np.zeros(len(a), np.int64)
    ends = hashes.extension(a, zero, a + 1, zero) + hashes.tail(a, a + 1)
    return np.maximum(hashes.walked(every), np.minimum(ends, np.minimum(hashes.size[a], hashes.size[a + 1])))


def _part(agree: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of the longer text; less than 1, which is for equal texts."""
    longer = np.maximum(size, other)
    return np.minimum(agree / np.maximum(longer, 1), 1 - 1 / (longer + 1.0))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all texts but the last, which is the next of the one before."""
    hashes = PrefixHashes(texts)
    longest, m = int(hashes.size.max(initial=0)), len(texts) - 1
    every = np.arange(m + 1)
    own = Fingerprints(hashes.size, lambda k, n: hashes.prefix(k, every[:, None], n), longest)
    size, following = hashes.size[:m], hashes.size[1:]
    cut = size - size // 3
    taken = np.minimum(size // 3, following)

    def edited_prefix(k: int, n: np.ndarray) -> np.ndarray:
        """From the two prefix arrays alone: the text up to the cut, then the next text moved there."""
        rows, c = every[:m, None], cut[:, None]
        head = hashes.prefix(k, rows, np.minimum(n, c))
        tail = hashes.prefix(k, rows + 1, np.maximum(n - c, 0))
        return (head + tail * _POWERS[k].upto(longest)[c] % P) % P

    edited = Fingerprints(cut + taken, edited_prefix, longest)
    text = [t[:c] + u[:k] for t, u, c, k in zip(texts[:m], texts[1:], cut.tolist(), taken.tolist(), strict=True)]
    mine, after = own.take(every[:m]), own.take(every[1:])
    near_next = np.maximum(likeness(mine, after), _part(_in_common(hashes, 1), size, following))
    # Up to the cut a text and its edited one are the same.
    tails = PrefixHashes([t for a, b, c, k in zip(texts[:m], texts[1:], cut.tolist(), taken.tolist(), strict=True) for t in (a[c:], b[:k])])
    near_edited = np.maximum(likeness(mine, edited), _part(cut + _in_common(tails, 2), size, edited.size))
    columns = [
        pa.array(ids[:m], pa.int64()),
        pa.array(size),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in text]),
        pa.array(mine.strings()),
        pa.array(edited.strings()),
        pa.array(near_edited),
        pa.array(near_next),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range in its order, the next range's first document last."""
    claim()
    ids: list = []
    texts: list[str] = []
    for batch in batches:
        for part in text_slices(batch, most=SLICE):
            ids += part.column("doc_id").to_pylist()
            texts += part.column("text").to_pylist()
            if len(ids) > 1:
                yield compare_with_next(ids, texts)
                ids, texts = ids[-1:], texts[-1:]


def _range_of(bounds: np.ndarray):
    @F.arrow_udf("int")
    def number(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False)).astype(np.int32))

    return number


_FIRST = -(1 << 63)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document, compared with its edited text and with the next document by descending doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = ranges or partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("_o"))
    found = rows.agg(F.percentile_approx("_o", [(i + 1) / n for i in range(n)], 100 * n).alias("b"), F.max("_o").alias("top")).first()
    bounds = np.array(sorted({*(found["b"] or []), *([] if found["top"] is None else [found["top"]])}), np.int64)
    if not len(bounds):
        return spark.createDataFrame([], SCHEMA)
    number = _range_of(bounds)
    heads = rows.where(F.col("_o").isin(bounds.tolist())).groupBy("_o").agg(F.min("text").alias("text"))
    heads = heads.select(F.col("_o").alias("doc_id"), "text", "_o", F.pmod(number("_o") + 1, F.lit(len(bounds))).alias("_range"), F.lit(1).alias("_head"))
    dealt = rows.withColumn("_range", number("_o")).withColumn("_head", F.lit(0)).unionByName(heads)
    dealt = dealt.repartitionById(len(bounds), F.col("_range")).sortWithinPartitions("_head", F.desc("_o"), "text")
    return dealt.select("doc_id", "text").mapInArrow(_rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
