"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks.

The kernel of two strings sums, over all pairs of equal subsequences of ``ORDER`` letters, ``DECAY`` to the power of the
letters that both skip. Characters that aren't letters are no part of a unit, so ``i.d.i.o.t`` is ``idiot``; inserted, left
out or changed letters thin subsequences out or cost some of them.

*Units* are the words of a text in lower case; runs of three and more single-letter words (each with one mark behind it or
none) are one unit and lie in one sentence, and words of more than ``WINDOW`` characters give overlapping windows, so that texts
are covered whole. *Landmarks* are strings of 4 to 12 letters, or whole words of 3, that training documents marked toxic have
and others lack, chosen one after another by how many toxic documents each adds; a string that the kernel finds like a
chosen one isn't chosen beside it. A sentence's vector has the largest normalised kernel values of each landmark with spans
of its units (from one letter less than the landmark to two more), at most 1. Pairs that lack over a quarter of a landmark's
letters in order have a value of 0 without being computed (``in_order=0`` computes all).

The machine's kernel is the sum of powers of the subsequence kernel (``POWERS``), each of which is a kernel too; its Nystroem
map has, for each power, the powers of a vector turned by the inverse square root of the landmarks' kernel matrix to that
power. The low power tolerates gaps and inserted letters, the high one tells a landmark from words that are near it.

A linear machine is trained on sentences: those of toxic documents that have a landmark or are nearest to one, and again
those that the machine ranks first, with bent landmarks (a letter more or less), against those of clean documents. A
document's margin is its largest sentence's; a logistic curve fitted on the training documents and the bent landmarks makes
a score from 0 to 1.

The fit takes at most ``LABELLED`` labelled documents and ``FIT_BYTES`` bytes of their texts, by the order of their ids'
hashes, and ``CANDIDATES`` candidates for landmarks, by the number of toxic documents that have them, then by the alphabet;
everything else covers all rows.

Defined cases: null, empty and blank texts have the score of a sentence without any landmark; repeated rows are scored
each; of labelled rows that share an id the greatest text counts, and it is toxic if one of its labels says so; a table of
labels without a toxic or without a clean document gives every text the share of toxic labels (0 without labels); of equal
candidates the first by the alphabet is chosen; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import bounded_batches, claim, documents, give_back, text_slices, words

ORDER, DECAY = 3, 0.85
POWERS = (2, 12)
LABELLED, FIT_BYTES, CANDIDATES = 4000, 128 << 20, 5000
LANDMARKS = 64
#: Letters of a string within a word, and of a whole word, that can be a landmark; and the likeness that rules out another one.
SHORTEST, WHOLE, LONGEST, ALIKE = 4, 3, 12, 0.6
WINDOW = 32
#: Share of a landmark's letters that a unit must have in order.
IN_ORDER = 0.75


def units_of(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units; for every unit in the texts its number, its sentence's number, and each sentence's text."""
    offsets, coded = words(column)
    n = len(offsets) - 1
    distinct = pc.utf8_lower(coded.dictionary)
    index = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    ends = pc.match_substring_regex(distinct, r"[.!?]$").to_numpy(zero_copy_only=False).astype(bool)
    strings = distinct.to_pylist()
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    # Runs of single letters, which end with their text; within one a mark ends no sentence.
    single = np.fromiter((s.isalpha() if len(s) == 1 else len(s) == 2 and s[0].isalpha() and not s[1].isalpha() for s in strings), bool, len(strings))[index]
    last = ends[index]
    runs: list[tuple[int, int]] = []
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.where(single, doc, -1), [-1]])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if single[a] and b - a >= 3:
                runs.append((a, b))
                last[a : b - 1] = False
    # A sentence ends after its mark and with its text.
    first = offsets[:-1][np.diff(offsets) > 0]
    start = np.zeros(len(index), bool)
    start[1:] = last[:-1]
    start[first] = True
    sentence = np.cumsum(start) - 1
    text_of = doc[start]
    more_index, more_sentence = [], []
    number: dict[str, int] = {}
    own = lambda s: number.setdefault(s, len(strings) + len(number))
    for k in np.flatnonzero(lengths[index] > WINDOW).tolist():
        word = strings[index[k]]
        pieces = [own(word[a : a + WINDOW]) for a in range(0, len(word), WINDOW // 2)]
        more_index.append(np.array(pieces))
        more_sentence.append(np.full(len(pieces), sentence[k]))
    for a, b in runs:
        joined = "".join(strings[k][0] for k in index[a:b].tolist())
        pieces = [own(joined[e : e + WINDOW]) for e in range(0, len(joined), WINDOW // 2)]
        more_index.append(np.array(pieces))
        more_sentence.append(np.full(len(pieces), sentence[a]))
    if more_index:
        index, sentence = np.concatenate([index, *more_index]), np.concatenate([sentence, *more_sentence])
    strings = [s if k <= WINDOW else "" for s, k in zip(strings, lengths.tolist(), strict=True)] + list(number)
    strings = [s if s.isalpha() else "".join(filter(str.isalpha, s)) for s in strings]
    return strings, index, sentence, text_of


#: Codes of no letter, and of all letters that no landmark has.
NONE, OTHER = 0, 254


@dataclass
class Landmarks:
    """Landmarks in codes from 1 up for the letters that occur in one of them."""

    strings: list[str]
    in_order_share: float = IN_ORDER

    def __post_init__(self):
        letters = sorted(set("".join(self.strings)))[: OTHER - 1]
        self.code = np.full(0x110000, OTHER, np.uint8)
        self.code[[0, *map(ord, letters)]] = np.arange(len(letters) + 1)
        self.width = max(map(len, self.strings))
        self.codes = self.encode(self.strings)
        self.sizes = np.array([len(s) for s in self.strings])
        self.least = np.ceil(self.in_order_share * self.sizes).astype(int)
        self.masks = self._masks(self.codes)
        self.need = np.ceil(self.in_order_share * np.array([len(set(s)) for s in self.strings])).astype(int)
        self.places = np.zeros((len(self.strings), 256), np.uint32)
        for k in range(self.width):
            at = np.flatnonzero(self.sizes > k)
            self.places[at, self.codes[at, k]] |= np.uint32(1 << k)
        self.places[:, [NONE, OTHER]] = 0
        self.own = self.kernel(self.codes, self.codes)
        n = len(self.strings)
        gram = self.kernel(np.repeat(self.codes, n, 0), np.tile(self.codes, (n, 1))).reshape(n, n) / np.sqrt(np.outer(self.own, self.own))
        self.turns = []
        for power in POWERS:
            value, vector = np.linalg.eigh(gram**power)
            self.turns.append(vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T)

    @staticmethod
    def _masks(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), 4), np.uint64)
        for j in range(codes.shape[1]):
            c = codes[:, j]
            out[np.arange(len(c)), c >> 6] |= np.where(c > 0, np.uint64(1) << (c & 63).astype(np.uint64), np.uint64(0))
        return out

    def encode(self, strings: list[str]) -> np.ndarray:
        n = max(1, max(map(len, strings), default=1))
        wide = np.array(strings, f"<U{n}").view("<u4").reshape(len(strings), n)
        return self.code[np.minimum(wide, 0x10FFFF)]

    @staticmethod
    def kernel(units: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The subsequence kernel of rows of codes, pair by pair."""
        m = target.shape[1]
        later = np.triu(DECAY ** np.maximum(np.arange(m)[None, :] - np.arange(m)[:, None], 0).astype(np.float64))
        columns = [np.zeros((len(units), m)) for _ in range(ORDER - 1)]
        sums = [np.zeros((len(units), m)) for _ in range(ORDER - 1)]
        total = np.zeros(len(units))
        for j in range(units.shape[1]):
            here = units[:, j : j + 1]
            match = ((here == target) & (here > 0)).astype(np.float64)
            for i in range(ORDER - 1, -1, -1):
                if i:  # ends here, after what ended before in both
                    ending = match.copy()
                    ending[:, 0] = 0
                    ending[:, 1:] *= sums[i - 1][:, :-1]
                else:
                    ending = match
                if i == ORDER - 1:
                    total += ending.sum(1)
                else:
                    columns[i] = ending + DECAY * columns[i]
                    sums[i] = columns[i] @ later
        return total

    def in_order(self, units: np.ndarray, landmark: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of rows and landmarks, pair by pair, by bits."""
        size = self.sizes[landmark]
        every = ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        v = every.copy()
        for j in range(units.shape[1]):
            u = v & self.places[landmark, units[:, j]]
            v = ((v + u) | (v - u)) & every
        return size - np.bitwise_count(v).astype(np.int64)

    def values(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, landmark and value of all pairs whose value isn't 0."""
        units = self.encode(strings)
        masks = self._masks(units)
        pairs_u, pairs_l = [], []
        for i in range(len(self.strings)):
            words_used = np.flatnonzero(self.masks[i])
            shared = sum(np.bitwise_count(masks[:, w] & self.masks[i, w]).astype(np.int64) for w in words_used)
            near = np.flatnonzero(shared >= self.need[i])
            pairs_u.append(near)
            pairs_l.append(np.full(len(near), i))
        u, k = np.concatenate(pairs_u), np.concatenate(pairs_l)
        near = np.zeros(len(u), bool)
        for a in range(0, len(u), 100_000):
            b = slice(a, a + 100_000)
            near[b] = self.in_order(units[u[b]], k[b]) >= self.least[k[b]]
        u, k = u[near], k[near]
        out = np.zeros(len(u))
        for a in range(0, len(u), 20_000):
            b = slice(a, a + 20_000)
            out[b] = self._best(units, u[b], k[b])
        some = out > 0
        return u[some], k[some], out[some]

    def _best(self, units: np.ndarray, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The largest normalised kernel of a landmark with the unit's spans of a letter less to two more."""
        wide = np.zeros((len(u), units.shape[1] + self.width + 2), np.uint8)
        wide[:, : units.shape[1]] = units[u]
        length = (wide > 0).sum(1)
        out = np.zeros(len(u))
        for start in range(units.shape[1]):
            ahead = np.flatnonzero(start + self.least[k] <= length)
            if not len(ahead):
                break
            # No span from here has more of the landmark in order than the longest.
            longest = wide[ahead, start : start + self.width + 2]
            ahead = ahead[self.in_order(longest, k[ahead]) >= self.least[k[ahead]]]
            for more in (-1, 0, 1, 2):
                size = self.sizes[k[ahead]] + more
                at = ahead[(start + size <= length[ahead]) | (more == -1)]
                if not len(at):
                    continue
                span = wide[at, start : start + self.width + 2].copy()
                span[np.arange(span.shape[1])[None, :] >= (self.sizes[k[at]] + more)[:, None]] = NONE
                ok = self.in_order(span, k[at]) >= self.least[k[at]]
                at, span = at[ok], span[ok]
                if len(at):
                    own = self.kernel(span, span) * self.own[k[at]]
                    out[at] = np.maximum(out[at], self.kernel(span, self.codes[k[at]]) / np.sqrt(np.maximum(own, 1e-9)))
        return np.minimum(out, 1.0)

    def features(self, vectors: np.ndarray) -> np.ndarray:
        """The Nystroem map: powers of the values, each turned by the root of the landmarks' matrix to that power."""
        return np.hstack([vectors**power @ turn for power, turn in zip(POWERS, self.turns, strict=True)])

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the sentences with a value, and the text of each."""
        strings, index, sentence, text_of = units_of(column)
        if not strings:
            return np.empty((0, len(self.strings))), np.empty(0, np.int64)
        u, k, value = self.values(strings)
        hit = np.zeros(len(strings), bool)
        hit[u] = True
        at = np.flatnonzero(hit[index])
        found = np.unique(sentence[at])
        out = np.zeros((len(found), len(self.strings)))
        table = np.zeros((len(strings), len(self.strings)), np.float32) if len(strings) * len(self.strings) <= 4_000_000 else None
        if table is None:
            row = np.full(len(strings), -1)
            row[hit] = np.arange(int(hit.sum()))
            table = np.zeros((int(hit.sum()), len(self.strings)), np.float32)
        else:
            row = np.arange(len(strings))
        table[row[u], k] = value
        place = np.searchsorted(found, sentence[at])
        order = np.argsort(place, kind="stable")
        if len(order):
            out = np.maximum.reduceat(table[row[index[at[order]]]], np.searchsorted(place[order], np.arange(len(found))), axis=0).astype(np.float64)
        return out, text_of[found]


def _codes(strings: list[str]) -> np.ndarray:
    """Strings in rows of codes of their letters, 0 behind them."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(strings))), 1)}
    out = np.zeros((len(strings), max(map(len, strings))), np.int64)
    for row, s in zip(out, strings, strict=True):
        row[: len(s)] = [letters[c] for c in s]
    return out


def choose(texts: list[str], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Strings that toxic texts have and others lack, each chosen for the toxic texts that it adds."""
    strings, index, sentence, text_of = units_of(pa.array(texts, pa.large_string()))
    doc = text_of[sentence]
    pairs = np.unique(index.astype(np.int64) * len(texts) + doc)
    word, doc = pairs // len(texts), pairs % len(texts)
    by_word = np.split(doc, np.searchsorted(word, np.arange(1, len(strings))))
    total = np.array([(~toxic).sum(), toxic.sum()])
    parts = lambda s: {s[a:b] for a in range(len(s) - SHORTEST + 1) for b in range(a + SHORTEST, min(len(s), a + 8) + 1)} | ({s} if WHOLE <= len(s) <= LONGEST else set())
    candidates: Counter[str] = Counter()
    for s, own in zip(strings, by_word, strict=True):
        bad = int(toxic[own].sum())
        if bad and bad / total[1] > 4 * (len(own) - bad) / total[0]:
            for part in parts(s):
                candidates[part] += bad
    candidates = Counter(dict(sorted(candidates.items(), key=lambda x: (-x[1], x[0]))[:CANDIDATES]))
    docs_of: dict[str, list[np.ndarray]] = defaultdict(list)
    for s, own in zip(strings, by_word, strict=True):
        for part in parts(s):
            if part in candidates:
                docs_of[part].append(own)
    column_of = np.cumsum(toxic) - 1
    names, rows, costs = [], [], []
    for part, lists in sorted(docs_of.items()):
        own = np.unique(np.concatenate(lists))
        bad, good = own[toxic[own]], len(own) - int(toxic[own].sum())
        if len(bad) >= 3 and len(bad) / total[1] > 20 * good / total[0]:
            row = np.zeros(int(total[1]), bool)
            row[column_of[bad]] = True
            names.append(part)
            rows.append(row)
            costs.append(10 * good * total[1] / total[0])
    chosen: list[str] = []
    if not names:
        return chosen
    has, cost = np.array(rows, np.float32), np.array(costs)
    longer = 1 + 0.03 * np.array([len(x) for x in names])
    codes = _codes(names)
    self_value = np.sqrt(Landmarks.kernel(codes, codes))
    left, open_ = np.ones(int(total[1]), np.float32), np.ones(len(names), bool)
    while open_.any() and len(chosen) < most:
        # A toxic text counts less for each landmark that it has already.
        gain = has @ left - cost
        best = int(np.argmax(np.where(open_, gain * longer, -np.inf)))
        if gain[best] < 2:
            break
        chosen.append(names[best])
        left[has[best] > 0] *= 0.3
        # Of strings that hold one another, another one goes on only where it is cleaner.
        related = np.array([x in names[best] or names[best] in x for x in names])
        open_ &= ~related | (cost < cost[best])
        # The kernel tolerates what is like it.
        alike = Landmarks.kernel(codes, np.repeat(codes[best : best + 1], len(codes), 0)) / (self_value * self_value[best])
        open_ &= alike < ALIKE
        open_[best] = False
    return chosen


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 20.0, rounds: int = 20) -> np.ndarray:
    """A linear machine with squared hinge loss by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    ridge = 1 / (2 * cost * share)
    square = (x * x).sum(1) + ridge
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            new = max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1 + ridge[i] * alpha[i]) / square[i])
            if step := new - alpha[i]:
                w += step * y[i] * x[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve through margins, after Platt."""
    good = (label.sum() + 1) / (label.sum() + 2)
    bad = 1 / ((1 - label).sum() + 2)
    goal = np.where(label > 0, good, bad)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = p - goal, p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0
    flat: float = 0.0

    def margins(self, column: pa.Array) -> np.ndarray:
        bias = self.weights[-1]
        out = np.full(len(column), bias)
        vectors, text = _known(tuple(self.landmarks)).sentences(column)
        if len(text):  # sentences without a value have the bias alone
            turned = _known(tuple(self.landmarks)).features(vectors)
            np.maximum.at(out, text, turned @ self.weights[:-1] + bias)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(column), self.flat)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -30, 30)))


_KNOWN: dict[tuple[str, ...], Landmarks] = {}


def _known(strings: tuple[str, ...]) -> Landmarks:
    if strings not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[strings] = Landmarks(list(strings))
    return _KNOWN[strings]


def variants(landmark: str) -> list[str]:
    """A landmark with a letter more, a letter twice, and, from six letters on, a letter less, at each inner place."""
    out = []
    for k in range(1, len(landmark)):
        out += [landmark[:k] + "x" + landmark[k:], landmark[:k] + landmark[k - 1] + landmark[k:]]
        if len(landmark) >= 6 and k < len(landmark) - 1:
            out.append(landmark[:k] + landmark[k + 1 :])
    return out


def fit(texts: list[str], labels: list[int]) -> Model:
    toxic = np.array(labels, bool)
    share = float(toxic.mean()) if len(toxic) else 0.0
    chosen = choose(texts, toxic) if 0 < share < 1 else []
    if not chosen:
        return Model([], flat=share)
    marks = _known(tuple(chosen))
    column = pa.array(texts, pa.large_string())
    vectors, text = marks.sentences(column)
    turned = np.vstack([marks.features(vectors), np.zeros((1, len(POWERS) * len(chosen)))])
    text = np.append(text, -1)  # the sentence without any landmark is clean
    bad = np.flatnonzero(np.isin(text, np.flatnonzero(toxic)))
    good = np.flatnonzero(~np.isin(text, np.flatnonzero(toxic)))
    bent, row = marks.sentences(pa.array([v for m in chosen for v in variants(m)], pa.large_string()))
    bent = marks.features(bent)
    rank = vectors.max(1)
    whole = bad[rank[bad] > 0.99]
    # Clean sentences often have the same vector; one of each does.
    good = good[np.unique(turned[good].round(6), axis=0, return_index=True)[1]]
    model = Model(chosen)
    for _ in range(2):
        order = bad[np.lexsort((-rank[bad], text[bad]))]
        first = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])] if len(order) else order
        first = np.union1d(first, whole)
        rows = np.concatenate([first, good])
        sure = np.arange(len(rows) + len(bent)) < len(first)
        sure[len(rows) :] = True
        model.weights = _machine(np.vstack([turned[rows], bent]), np.where(sure, 1.0, -1.0))
        rank = turned[:-1] @ model.weights[:-1]
    near = bent @ model.weights[:-1] + model.weights[-1]
    model.slope, model.shift = _curve(np.concatenate([model.margins(column), near]), np.concatenate([toxic.astype(float), np.ones(len(near))]))
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _fold(folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, most: int = LABELLED) -> Model:
    """A model from at most ``most`` labelled rows, and FIT_BYTES of them, outside of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_fold(folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = own.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    # At most ``most`` rows from here on.
    ahead = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_bytes", ahead).where(F.col("_bytes") <= FIT_BYTES).select("doc_id", "toxic", "text")
    found = rows.repartition(1).mapInArrow(_fit, "landmarks array<string>, weights array<double>, slope double, shift double, flat double").first()
    if found is None:  # no row, so no task
        return Model([])
    return Model(found["landmarks"], np.array(found["weights"]) if found["weights"] else None, found["slope"], found["shift"], found["flat"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fit in one task, whose rows the bound holds, so that the driver never has the texts."""
    claim()
    rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    model = fit([text for *_, text in rows], [label for _, label, _ in rows])
    weights = None if model.weights is None else model.weights.tolist()
    values = [model.landmarks, weights, model.slope, model.shift, model.flat]
    types = [pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["landmarks", "weights", "slope", "shift", "flat"])
    del rows
    give_back()


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            for part in text_slices(batch):
                score = model.scores(part.column("text"))
                columns = [part.column(i) for i in range(part.num_columns - 1)] + [pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, ``held_out``, ``score``, ``predicted``."""
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, folds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fold(folds).alias("held_out"), "text")
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic."""
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, folds)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            for part in text_slices(batch):
                yield part.filter(pa.array(model.scores(part.column("text")) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
