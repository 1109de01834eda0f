"""The Kneser-Ney model against a plain version with dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import lm
from sluice.llm.common import words
from sluice.llm.shared_arrays import counted, from_planes, merged, planes


START, END = ("start",), ("end",)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [END]


def plain(train, texts):
    uni, bi = Counter(), Counter()
    for t in train:
        own = [START, *tokens(t)]
        uni.update(own)
        bi.update(zip(own, own[1:], strict=False))
    before, follow = Counter(), defaultdict(lambda: [0, 0, 0])
    for (v, w), c in bi.items():
        before[w] += 1
        follow[v][min(c, 3) - 1] += 1
    of = lambda counts: [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
    low, high = lm.discounts(*of(before)), lm.discounts(*of(bi))
    n, types = sum(c for w, c in uni.items() if w != START), len(uni) - (START in uni)
    cut = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)
    rest = sum(d * sum((min(c, 3) == k + 1) for c in before.values()) for k, d in enumerate(low)) / len(bi) / (types + 1)
    out = []
    for t in texts:
        own, score, base, known = [START, *tokens(t)], 0.0, 0.0, 0
        for v, w in zip(own, own[1:], strict=False):
            p = cut(before[w], low) / len(bi) + rest
            if v in uni:
                p = cut(bi[v, w], high) / uni[v] + sum(d * m for d, m in zip(high, follow[v], strict=True)) / uni[v] * p
            score += math.log10(p)
            c = uni[w] if w != START else 0
            known += c > 0
            base += math.log10((c + 1) / (n + types + 1))
        out.append((len(own) - 1, known, base, score))
    return n, out


def test_scores_against_dictionaries(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(1000, None), (1001, ""), (1002, " \t\n"), (1003, "<s> the</s>The THE ünknown <s>")], "doc_id long, text string"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in lm.perplexity_scores(docs.repartition(3)).collect()}
    train = [t for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    n, want = plain(train, rows.values())
    assert len(got) == len(rows)
    for (i, _), (size, known, base, score) in zip(rows.items(), want, strict=True):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, size, known, n)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(score)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_more_parts_than_bigrams(spark):
    docs = spark.createDataFrame([("a b",), ("c d",)], "text string")
    few, many = lm.train(docs, parts=1), lm.train(docs, parts=50)
    texts = pa.array(["a b c d", "b a d c", "d d d", None])
    assert lm.score_texts(many, texts)["score"].tolist() == pytest.approx(lm.score_texts(few, texts)["score"].tolist())
    assert len(many.gram_parts) < 50


def test_probabilities_add_up(spark):
    docs = spark.createDataFrame([("a b c",), ("a b b",), ("c a",), ("a b c a",)], "text string")
    model = lm.train(docs, parts=3)
    vocabulary = ["a", "b", "c"]
    for context in ("", "a", "b", "c", "zz"):
        p = 0.0
        for w in [*vocabulary, "unknown", None]:
            text = " ".join(x for x in (context, w) if x)
            whole = lm.score_texts(model, pa.array([text]))["score"][0]
            if w is None:
                p += 10 ** (whole - _without_end(model, context))
            else:
                p += 10 ** (_without_end(model, text) - _without_end(model, context))
        assert p == pytest.approx(1.0)


def _without_end(model, text):
    """A text's log probability up to its last word: the end's part is taken away by asking for it twice."""
    column = pa.array([text])
    hashes, starts = lm._sequence(column)
    maps = model.maps()
    low, high = model.discounts
    total = 0.0
    ids = [int(lm._by_value(hashes[k : k + 1], maps.ids)[0]) for k in range(len(hashes) - 1)]
    for v, w in zip(ids, ids[1:], strict=False):
        row = lambda i: maps.words(np.array([i]))[0] if i >= 0 else np.zeros(1, lm.WORD)[0]
        a = int(row(w)["before"]) if w >= 0 else 0
        p = max(a - (0, *low)[min(a, 3)], 0) / model.grams + model.rest
        if v >= 0:
            t, c = int(row(v)["count"]), int(maps.counts(np.array([v << 32 | max(w, 0)], np.uint64))[0]) if w >= 0 else 0
            p = max(c - (0, *high)[min(c, 3)], 0) / t + (high[0] * row(v)["n1"] + high[1] * row(v)["n2"] + high[2] * row(v)["n3"]) / t * p
        total += math.log10(p)
    return total


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.perplexity_scores(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.perplexity_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


def test_counts_past_32_bits_are_kept(tmp_path):
    assert lm.narrow(np.array([1, (1 << 32) - 1])).dtype == np.dtype("<u4")
    big = np.array([3, (1 << 32) + 5, 1])
    model = lm.Model(str(tmp_path), 1, [0], np.zeros(1, np.uint64))
    for name, counts in (("a", np.array([7, 8, 9])), ("b", big)):
        folder = str(tmp_path / name)
        lm.write_part(folder, "grams-0", np.array([5, 6, 7], "<u8"))
        lm.write_part(folder, "gram-counts-0", lm.narrow(counts))
        own = lm._Maps(lm.Model(folder, 1, [0], np.zeros(1, np.uint64), frozenset([0])))
        assert own.counts(np.array([4, 5, 6, 7, 8], np.uint64)).tolist() == [0, *counts.tolist(), 0]
    assert model.parts == 1


def test_bounds_deal_bigrams_out_evenly():
    """From few marks of each part, with one word that is a third of all."""
    rng = np.random.default_rng(3)
    parts, per = 8, 500
    counts = rng.integers(1, 50, parts * per)
    counts[1234] = counts.sum() // 2
    marks, before = [], 0
    for p in range(parts):
        own = counts[p * per : (p + 1) * per]
        marks += [(p * per + i, before + a, c) for i, a, c in zip(*lm._marks(own), strict=True)]
        before += int(own.sum())
    assert len(marks) <= parts * lm.MARKS
    bounds = lm._gram_bounds(marks, before, parts)
    share = counts / counts.sum()
    context, word = rng.choice(len(counts), 200_000, p=share), rng.choice(len(counts), 200_000, p=share)
    keys = context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
    sizes = np.bincount(np.searchsorted(bounds, keys, side="right") - 1, minlength=parts)
    # A pair that is itself a ninth of all stays in one part.
    assert sizes.max() < 0.3 * len(keys)
    assert lm._gram_bounds([], 0, 3).tolist() == [0, 0, 0]


def test_very_long_null_and_repeated_texts(spark):
    rows = [(1, "a b " * 200_000), (1, "a b " * 200_000), (2, None), (3, ""), (None, "a b"), (4, "x" * 300_000)]
    got = lm.perplexity_scores(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int")).collect()
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    n, want = plain(train, [t for _, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert [(i, m) for i, m in sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key)] == sorted(((i, w[0]) for (i, _), w in zip(rows, want, strict=True)), key=key)
    for (i, _), w in zip(rows, want, strict=True):
        assert any(r["doc_id"] == i and r["train_tokens"] == n and r["score"] == pytest.approx(w[3], rel=1e-6) for r in got)


def test_parts_in_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    import pyarrow.fs as pfs

    from sluice.llm import shared_arrays

    monkeypatch.setattr(shared_arrays, "_store", lambda path: (pfs.SubTreeFileSystem(str(tmp_path), pfs.LocalFileSystem()), path))
    shared_arrays.write_part("f", "a", np.arange(5, dtype="<u8"))
    shared_arrays.write_part("f", "a", np.arange(1000, dtype="<u8"))
    shared_arrays.write_part("f", "none", np.empty(0, "<u8"))
    assert shared_arrays.map_part("f", "a", "<u8").tolist() == list(range(1000))
    assert not len(shared_arrays.map_part("f", "none", "<u8"))
    assert [p.name for p in (tmp_path / "f").iterdir() if p.name.startswith("a")] == ["a"]
    with pytest.raises(FileNotFoundError):
        shared_arrays.map_part("f", "b", "<u8")
    assert not len(merged([], [])[0])


def test_arrays():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (from_planes(planes(keys), np.uint64) == keys).all()
    k, c = counted(np.array([3, 1, 3], np.uint64))
    assert (k.tolist(), c.tolist()) == ([1, 3], [1, 2])
    k, c = merged([k, k[:1]], [c, c[:1]])
    assert (k.tolist(), c.tolist()) == ([1, 3], [2, 2])


def test_words_of_slices():
    column = pa.array(["É a\x0bB\x1cc", None, "", "x y Z"] * 3).slice(3, 6)
    offsets, coded = words(column)
    flat = coded.to_pylist()
    got = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [["x y", "z"], ["É", "a", "b\x1cc"], [], [], ["x y", "z"], ["É", "a", "b\x1cc"]]
