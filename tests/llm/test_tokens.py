"""Token ids, their storage and their packing."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing, token_store
from sluice.llm.tokenizing import encode

ODD = ["", " ", "a  b", " a", "a ", "a b c", "a 　b", "x\x1cy z", "a\x85 b", "<|endoftext|> a<|endoftext|>b", "<|STARTOFTEXT|>", "don't  'll it 's", "a\n b\n\nc  d", "İx ΣΣ é", "a ́b", "a​ b", "a\x1f b", "a b", " ", "c   　d", "'s 't a's b 's", "w, w. w!! w#1 w's, é, é.", "A" * 300, "🙂 🙂🙂, ok", "1,234.5 12 a1,", "tab\tnew\nline\r\n"]
NAMES = [("word_bpe_49k.json", "words", 1), ("byte_bpe_50k.json", "spaces", 0)]


@pytest.mark.parametrize("name, split, end", NAMES)
def test_pieces_have_the_ids_of_whole_texts(tables, name, split, end):
    import pyarrow.parquet as pq

    texts = ODD + pq.read_table(f"{tables}/documents.parquet", columns=["text"]).column(0).to_pylist()
    whole = Tokenizer.from_file(P.path(name))
    for own in (texts, texts[::-1], [t for t in texts for _ in range(2)]):
        ids, counts = encode(pa.array(own, pa.large_string()), P.path(name), split, end, np.uint32)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [[*whole.encode(t, add_special_tokens=False).ids, end] for t in own]


def test_codes_go_round():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        x = rng.integers(0, 1 << 32, n).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = token_store.pack(x)
        assert len(control) == -(-n // 4)
        assert (token_store.unpack(control, data, n) == x).all()
    with pytest.raises(ValueError, match="bytes"):
        token_store.unpack(b"\x00", b"ab", 1)


@pytest.fixture
def docs(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(500, None), (3, "repeated id"), (-7, "first")]
    return spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, ids long").repartition(4)


def test_store_gives_all_ids_in_order(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 40)
    path = P.path("word_bpe_49k.json")
    token_store.write(docs, f"file://{tmp_path}/s", path, split="words")
    got = sorted(token_store.read(spark, f"file://{tmp_path}/s").collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(path)
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    start = 0
    left = list(want)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        match = next(x for x in left if x[0] == r["doc_id"] and [*whole.encode(x[1], add_special_tokens=False).ids, 1] == ids)
        left.remove(match)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(r["ids"]))
        start += len(ids)
    ranks = spark.read.parquet(f"file://{tmp_path}/s/ranks").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)


LONG = [(1, "word and, more. " * 60_000), (1, "word and, more. " * 60_000), (2, None), (2, None), (3, "x" * 200_000), (4, " " * 50_000 + "end")]


def test_very_long_and_equal_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 5) for i, t in LONG], "doc_id long, text string, start int").repartition(3)
    path = P.path("word_bpe_49k.json")
    token_store.write(docs, f"file://{tmp_path}/l", path, split="words")
    got = sorted(token_store.read(spark, f"file://{tmp_path}/l").collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in sorted(LONG, key=lambda x: (x[0], x[1] or ""))]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()
    rows = packing.best_fit(docs, P.path("byte_bpe_50k.json"))
    assert rows.columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]
    check_packing(rows.collect(), LONG, 2048)


def test_both_ways_to_split_one_vocabulary():
    from sluice.llm.tokenizing import pieces

    path = P.path("byte_bpe_50k.json")
    assert pieces(path, "words").gap and not pieces(path, "spaces").gap
    assert pieces(path, "words") is pieces(path, "words")


def test_empty_store(spark, tmp_path):
    token_store.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/e", P.path("word_bpe_49k.json"))
    assert token_store.read(spark, f"file://{tmp_path}/e").count() == 0


def check_packing(rows, docs, length):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 0])
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert any(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in texts[r["doc_id"]])
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert sum(r["length"] for r in rows) == sum(len(ids) for own in texts.values() for ids in own)
    return len(bins)


def test_packing(spark, docs):
    rows = packing.best_fit(docs, P.path("byte_bpe_50k.json"), length=64).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 64)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"]), []).append(r)
    for i, own in by_doc.items():
        if i != 3:
            own.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(len(own)))
            assert all(r["length"] == 64 for r in own[1:])
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0


def test_bins_against_a_plain_best_fit():
    rng = np.random.default_rng(4)
    bins, free = packing.Bins(100, 8), {}
    for size in rng.integers(1, 101, 3000).tolist():
        fits = [(f, k) for k, f in free.items() if f >= size]
        number, offset = bins.put(size)
        if fits:
            assert free[number] == min(f for f, _ in fits)
        else:
            assert number not in free
            if len(free) >= 8 and size < 100:
                tight = min(free.values())
                gone = next(k for k in free if k not in _open(bins) and free[k] == tight)
                del free[gone]
            free[number] = 100
        assert offset == 100 - free[number]
        free[number] -= size
        if not free[number]:
            del free[number]
        assert len(free) <= 8
        assert set(free) == _open(bins)


def _open(bins):
    return {k for stack in bins.stacks for k in stack}


@pytest.mark.parametrize("tasks", [1, 16])
def test_few_sequences_are_lost(spark, tables, tasks):
    rows = packing.best_fit(spark.read.parquet(f"{tables}/documents.parquet").repartition(tasks), P.path("byte_bpe_50k.json"))
    total, bins = rows.groupBy().sum("length").first()[0], rows.select("sequence_id").distinct().count()
    assert bins <= total / 2048 * 1.05 + 1
