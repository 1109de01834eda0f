"""Exact dedup, the Jaccard join, components and sharding against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sluice.llm import common, components, exact_dedup, sharding, trie_join

SPACES = r"[\x20\x09-\x0D]"
ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, "  "), (7, "x y"), (7, "x y"), (8, "xy "), (9, "é ü"), (10, "é ü"), (11, "z" * 5000), (None, "ab"), (12, "éü")]


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SPACES, "", t or ""), []).append((i, t or ""))
    return groups


@pytest.mark.parametrize("bits", [256, 8, 4])
def test_exact_groups(spark, bits):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, keep_id string").repartition(3)
    got = exact_dedup.exact_groups(docs, digest_bits=bits, salts=2).collect()
    groups = plain_groups(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        norm = next(n for n, own in groups.items() if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"])
        own = groups[norm]
        best = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(own))
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(groups) == len(set(kept))
    assert sorted((t or "") for _, t in exact_dedup.deduplicated(docs).select("doc_id", "text").collect()) == sorted(min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[1] for own in groups.values())
    assert exact_dedup.deduplicated(docs).columns == docs.columns


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0
    assert trie_join.jaccard_classes(empty).count() == 0
    assert sharding.rendezvous(empty, [1.0, 1.0]).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(seed, groups=6, size=30, words=80):
    rng = np.random.default_rng(seed)
    rows = []
    shared = [f"s{k}" for k in range(30)]
    for g in range(groups):
        base = [f"w{g}_{k}" for k in range(words)]
        for _ in range(size):
            own = list(base)
            for k in rng.choice(words, rng.integers(0, 5), replace=False):
                own[k] = f"e{rng.integers(10_000)}"
            if rng.random() < 0.5:
                own += shared
            rows.append((len(rows), " ".join(own)))
    return rows + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a"), (9005, "a b c d e f " * 400), (9006, "A b c d e f " * 700)]


@pytest.mark.parametrize(("block", "most"), [(2_000_000, 8192), (3000, 8192), (500, 8192), (2_000_000, 4), (1, 1)])
def test_links_against_all_pairs(spark, block, most):
    rows = near_copies(block % 7)
    want = plain_components(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, block long").repartition(3)
    got = {r["doc_id"]: r for r in trie_join.jaccard_classes(docs, block_grams=block, block_sets=most).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    classes = {}
    for i, t in rows:
        classes.setdefault(got[i]["class_id"], shingles(t))
    for i, own in classes.items():
        links = sum(1 for j, other in classes.items() if j != i and own and other and 100 * len(own & other) >= 80 * len(own | other))
        assert got[i]["links"] == links


def test_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 0), (2, text + " more", 0)], "doc_id long, text string, _drop int")
    got = sorted((r["doc_id"], r["component_id"]) for r in trie_join.jaccard_classes(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]
    assert sorted(str(r["doc_id"]) for r in trie_join.representatives(docs).collect()) == ["1", "1", "None"]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, b + " more"), (0, a + " more"), (5, a), (5, "quite another text that stands alone")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["class_id"], r["links"], r["component_id"]) for r in trie_join.jaccard_classes(docs).collect())
    assert got == [(0, 27, 0, 1, 0), (1, 26, 1, 1, 0), (1, 26, 1, 1, 1), (2, 27, 2, 1, 1), (5, 2, 5, 0, 5), (5, 26, 1, 1, 0)]
    assert sorted((r["doc_id"], r["text"][:1]) for r in trie_join.representatives(docs).collect()) == [(0, "a"), (1, "b"), (5, "q")]


def test_trie_memory_is_linear_in_sets():
    """Many short sets below one path, without any link."""
    import tracemalloc

    peaks = []
    for n in (2000, 8000):
        sets = [np.sort(np.concatenate([np.arange(8), [100 + 2 * k, 101 + 2 * k]])).astype(np.uint64) for k in range(n)]
        tracemalloc.start()
        assert not any(len(found) for _, found in trie_join.trie_links(sets, 80))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 100 << 20


def test_trie_finds_all_links():
    rng = np.random.default_rng(8)
    for _ in range(60):
        base = rng.integers(0, 400, (rng.integers(1, 4), 40)).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 25)):
            own = set(base[rng.integers(len(base))].tolist())
            own = {x for x in own if rng.random() > 0.08} | set(rng.integers(0, 400, rng.integers(0, 4)).tolist())
            sets.append(np.array(sorted(own) or [1], np.uint64))
        side = rng.integers(0, 2, len(sets))
        for s in (None, side):
            got = {i: set(found.tolist()) for i, found in trie_join.trie_links(sets, 80, s)}
            for i, a in enumerate(sets):
                want = {j for j, b in enumerate(sets) if j != i and (s is None or s[i] != s[j]) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
                assert got[i] == want


def test_components_of_long_chains(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(0, 400)] + [(int(a), int(a) + 1000) for a in rng.integers(500, 600, 50)] + [(7, 7)]
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == parent


def plain_shard(key, weights):
    """The winner by the definition, in Python."""
    scores = []
    for i, w in enumerate(weights):
        h = int(hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:12], 16)
        scores.append(-w / math.log((h + 0.5) / (1 << 48)))
    return scores.index(max(scores))


def test_equal_rows_are_numbered_in_many_buckets(spark):
    docs = spark.createDataFrame([(None, "same")] * 3000, "doc_id long, text string").repartition(7)
    got = sharding.rendezvous(docs, [1.0] * 8).collect()
    assert {r["shard"] for r in got} == {plain_shard(None, [1.0] * 8)}
    assert sorted(r["slot"] for r in got) == list(range(3000))


def test_shards(spark):
    rows = [(k, "x" * (k % 9)) for k in range(3000)] + [(None, None), (5, "again"), (5, "again")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    got = sharding.rendezvous(docs, [1.0, 1.0, 2.0]).collect()
    assert len(got) == len(rows)
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        assert sum(r["shard"] == s for r in got) == pytest.approx(len(rows) * (2 if s == 2 else 1) / 4, rel=0.15)
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    assert 0.15 < sum(r["grown_shard"] == 3 for r in got) / len(got) < 0.25
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], [1, 1, 2]), plain_shard(r["doc_id"], [1, 1, 2, 1]))
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in by_id.values())
    text = dict(rows)
    for r in got[:200]:
        if r["doc_id"] != 5:
            t = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
    grown = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(docs, [1.0, 1.0, 2.0, 1.0]).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in got)
    with pytest.raises(ValueError, match="weight"):
        sharding.rendezvous(docs, [1.0, 0.0])


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = exact_dedup.exact_groups(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 3000
    assert all((r["keep_id"], r["group_size"], r["kept"]) == ((0, 1000, i == 0) if i % 3 == 0 else (i, 1, True)) for i, r in got.items())
    # The copies' rows are dealt to many places, none of which has over a quarter of a task's share.
    winners = spark.createDataFrame([("hot", 1000), ("cold", 10)], "k string, n long")
    left = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", i) for i in range(10)] + [("none", 0), (None, 1)], "k string, i long")
    met = common.spread_join(left, winners, "k", "n", 1010).collect()
    assert len(met) == 1012
    assert all(r["n"] == {"hot": 1000, "cold": 10}.get(r["k"]) for r in met)
    places = [r["_copy"] for r in met if r["k"] == "hot"]
    assert len(set(places)) == 16 and max(places.count(p) for p in set(places)) < 1.6 * 1010 / 16


def test_the_largest_id_can_be_kept(spark):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, "ab"), (None, "a b"), (-top - 1, "x"), (top, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["text_sha256"][:4]): (r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    x, ab = (hashlib.sha256(t.encode()).hexdigest()[:4] for t in ("x", "ab"))
    assert got == {(top, ab): (None, False), (None, ab): (None, True), (-top - 1, x): (-top - 1, True), (top, x): (-top - 1, False)}


def test_components_with_hubs_and_odd_edges(spark):
    edges = [(0, k) for k in range(1, 2000)] + [(10**6, k) for k in range(2000, 4000)] + [(None, 5), (7, None), (3, 3), (-9, 10**6)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(2000), 0), **dict.fromkeys([10**6, -9, *range(2000, 4000)], -9)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def crossed(blocks=40, words=100):
    """Groups of three near copies, each of which has one run of words of the next group: one block, hardly any links."""
    rows = []
    for g in range(blocks):
        base = [f"w{g}_{k}" for k in range(words)]
        base[:5] = [f"x{g}_{k}" for k in range(5)]
        base[10:15] = [f"x{(g + 1) % blocks}_{k}" for k in range(5)]
        for c in range(3):
            own = list(base)
            own[50 + c] = f"e{g}_{c}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_chunks_of_a_block_get_only_classes_that_may_link(spark, monkeypatch):
    rows = crossed()
    want = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt, links = [], trie_join._links
    monkeypatch.setattr(trie_join, "_links", lambda r, tasks, *a: (dealt.append(tasks.selectExpr("sum(size(deals))", "count(*)").first()), links(r, tasks, *a))[1])
    # One order of all members, so that those of two groups are the first in each.
    monkeypatch.setattr(trie_join, "commonness", lambda r, n: np.zeros(trie_join.PLACES, np.uint16))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in trie_join.jaccard_classes(docs, block_grams=1200, block_sets=8192).collect()}
    assert got == want
    assert dealt[0][0] < 3 * dealt[0][1]


@pytest.mark.parametrize(("rows_of_a_pair", "rounds"), [(20_000, 0.4), (0, 2)])
def test_rounds_and_whole_chunks_find_all_links(spark, monkeypatch, rows_of_a_pair, rounds):
    rows = near_copies(3, groups=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(trie_join.jaccard_classes(docs).collect())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in want} == plain_components(rows)
    monkeypatch.setattr(trie_join, "PAIR_ROWS", rows_of_a_pair)
    monkeypatch.setattr(trie_join, "ROUND", rounds)
    assert sorted(trie_join.jaccard_classes(docs, block_grams=3000, block_sets=8).collect()) == want


def test_representatives_of_a_block_of_many_chunks(spark, monkeypatch):
    """The pipeline's near dedup, in several chunks and rounds."""
    rows = near_copies(5, groups=1, size=12)
    monkeypatch.setattr(trie_join, "ROUND", 0.4)
    classes = trie_join.jaccard_classes
    monkeypatch.setattr(trie_join, "jaccard_classes", lambda d, n, p: classes(d, n, p, block_grams=600, block_sets=8))
    kept = trie_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in plain_components(rows).values()})
