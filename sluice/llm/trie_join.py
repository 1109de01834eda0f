"""Jaccard join of n-gram sets in prefix trees.

A document's set has the 64-bit hashes of its distinct runs of ``n`` words. Equal sets are one *class*, which its
smallest doc_id stands for. Classes link when ``100 * shared >= percent * united``.

1. One order of all n-grams holds everywhere: by how often their place in a table of 2**24 counts over hashes occurs (a
   fixed size; n-grams may share a place), then by hash. Two sets that link share one of the first
   ``size - ceil(percent * size / 100) + 1`` members of each in that order, which are mostly the rarest.
2. Classes that share such a member are chained by size, as far as neighbours' sizes are near enough to link, and the
   chains' components are *blocks*: sets of two blocks cannot link. Members that occur in one class only, and classes without shared ones, drop out there.
3. Classes are sorted over all tasks by block and by their rarest member, and cut into *chunks* of at most ``BLOCK_GRAMS / 2``
   members and ``BLOCK_SETS / 2`` classes. A chunk's whole sets go to one task. Where a block has several chunks, a task
   besides takes, of each two of them, the classes that share a member with a class of the other chunk and may link by
   both sizes and by what comes behind that member in their order; no others can have a link between them. (Of members in
   very many classes of many chunks, see ``PAIR_ROWS``, it takes both chunks whole.) So no task holds more than two chunks,
   and none holds a block for being one. What is sent follows the classes that may link, not the square of a block's
   chunks, and goes out in rounds of at most about ``ROUND`` times the sets themselves, so that disk stays in proportion.
4. A task lays its sets in a trie, by the block's own order with its commonest n-grams first, so that near copies share
   long paths. It goes down once for all sets: a node keeps how much of its path every set has (one vector, shared by
   all sets below), and drops sets that cannot reach the overlap that they need, even if all that remains of the longer
   path or of the set itself were shared; a subtree that no set can reach is pruned. At a set's end the vector has the
   exact overlaps. Links come out as their components' edges only, and as counts.
5. The edges' components are the result.

Nothing is dropped or capped: the table of counts and the order only decide how many candidates are looked at.

Defined cases: a text of fewer than ``n`` words but one at least has its whole sequence as its one n-gram; null, empty and
blank texts have an empty set and link with nothing; repeated rows are one class; rows that share an id but not a text
are documents of their own, so an id may have several classes; null ids are left out; an empty table gives no rows. A
class and a component are named by their smallest id. Columns other than id and text aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, claim, clear_shuffles, documents, extend, give_back, materialise, partitions, spread_join, text_slices, word_hashes, words
from sluice.llm.components import components

N, PERCENT = 5, 80
#: Places of the table of counts.
PLACES = 1 << 24
_SHIFT = np.uint64(64 - 24)
_PIECES = 64
#: Members and classes that one task takes; a chunk has half of each.
BLOCK_GRAMS, BLOCK_SETS = 1_000_000, 4096
#: Rows of classes and tasks up to this number go to executors as a broadcast table of five numbers each.
BROADCAST_CLASSES = 1_000_000
#: Classes times chunks of a shared member up to which its classes are told one by one which chunks they meet.
PAIR_ROWS = 20_000
#: Times all blocks' members that are sent at once; beyond, tasks run in several rounds.
ROUND = 2


def shingle_sets(column: pa.Array, n: int = N) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's runs of n words."""
    offsets, coded = words(column)
    hashes = word_hashes(coded)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    runs = hashes.copy()
    for k in range(1, n):
        # Runs go on as far as the document does, so that short texts end as their whole sequence.
        more = np.zeros(len(runs), bool)
        more[: max(0, len(runs) - k)] = doc[: max(0, len(doc) - k)] == doc[k:]
        at = np.flatnonzero(more)
        runs[at] = extend(runs[at], hashes[at + k])
    place = np.arange(len(runs)) - offsets[:-1][doc]
    whole = (place + n <= size[doc]) | ((place == 0) & (size[doc] < n))
    runs, doc = runs[whole], doc[whole]
    out = []
    cuts = np.searchsorted(doc, np.arange(len(size) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = np.sort(runs[a:b])
        if b - a > 1:
            new = np.empty(b - a, bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        out.append(own)
    return out


def prefix_length(size: np.ndarray | int, percent: int = PERCENT):
    return size - -(-percent * size // 100) + 1


def _count_places(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        held, size = [], 0
        total = np.zeros(PLACES, np.uint32)

        def add() -> None:
            places, counts = np.unique(np.concatenate(held) >> _SHIFT, return_counts=True)
            total[places] += counts.astype(np.uint32)

        for batch in batches:
            for part in text_slices(batch):
                own = shingle_sets(part.column("text"), n)
                held += own
                size += sum(map(len, own))
                if held and size >= 1_000_000:
                    add()
                    held, size = [], 0
        if size:
            add()
        pieces = np.split(total, _PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in pieces], pa.binary())], ["piece", "counts"])

    return run


def _sum_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
            total[piece] = total[piece] + own if piece in total else own
    for piece, own in total.items():
        # Counts themselves, or in steps of a thousandth of the usual count where that is over a thousand.
        step = max(1, int(np.median(own)) // 1000)
        level = np.minimum(own // np.uint64(step), 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], ["piece", "level"])


def commonness(rows: DataFrame, n: int = N) -> np.ndarray:
    """A level for each place of the table; 32 MB whatever the size of the corpus."""
    counted = rows.select("text").mapInArrow(_count_places(n), "piece int, counts binary")
    levels = counted.repartitionById(_PIECES, F.col("piece")).mapInArrow(_sum_places, "piece int, level binary").collect()
    out = np.zeros(PLACES, np.uint16)
    step = PLACES // _PIECES
    for r in levels:
        out[r["piece"] * step : (r["piece"] + 1) * step] = np.frombuffer(zlib.decompress(r["level"]), np.uint16)
    return out


INFO = "doc_id long, n_shingles long, k1 long, k2 long, prefix array<long>"


def _describe(level, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        claim()
        table = np.frombuffer(zlib.decompress(level.value), np.uint16)
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"), n)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                prefixes = []
                for own in sets:
                    # By level; within one the sets' own order, by hash.
                    order = np.argsort(table[own >> _SHIFT], kind="stable")[: prefix_length(len(own), percent)]
                    prefixes.append(own[order])
                counts = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
                prefix = pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), prefix], [x.split()[0] for x in INFO.split(", ")])

    return run


def _chains(percent: int):
    """From rows by gram, size and class in order: each class with the next one of its gram, if their sizes may link.

    Where two classes of a gram may link, so may all neighbours between them, so chains hold every pair together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([last, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "size", "node")])], 1)
            last = rows[:, -1:]
            gram, size, node = rows
            link = (gram[1:] == gram[:-1]) & (100 * size[:-1] >= percent * size[1:]) & (node[1:] != node[:-1])
            if link.any():
                pairs = np.unique(np.stack([node[:-1][link], node[1:][link]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return run


class Trie:
    """Sets in one order as a path-compressed prefix tree.

    A node has a run of members, children, the sets that end there, and the least and most members that sets below it
    have in all.
    """

    __slots__ = ("children", "ends", "least", "most", "run")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, [], []
        self.least = self.most = 0

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Trie:
        """sets: ascending ranks; they need not be distinct."""
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        root = cls(np.empty(0, np.uint32))
        path: list[tuple[Trie, int]] = [(root, 0)]  # nodes down to the last set, and the depth where each ends
        last = np.empty(0, np.uint32)
        for i in order:
            own = sets[i]
            m = min(len(own), len(last))
            differ = np.flatnonzero(own[:m] != last[:m])
            shared = int(differ[0]) if len(differ) else m
            while len(path) > 1 and path[-2][1] >= shared:
                path.pop()
            node, depth = path[-1]
            if depth > shared:  # the node's run is cut in two
                above = path[-2][1]
                upper = cls(node.run[: shared - above])
                node.run = node.run[shared - above :]
                siblings = path[-2][0].children
                siblings[-1] = upper
                upper.children.append(node)
                path[-1] = (upper, shared)
                node = upper
            if len(own) > shared:
                leaf = cls(own[shared:])
                node.children.append(leaf)
                path.append((leaf, len(own)))
                node = leaf
            node.ends.append(i)
            last = own
        return root

    def measure(self, sizes: np.ndarray) -> None:
        """Fills least and most, bottom up."""
        stack, order = [self], []
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node.children
        for node in reversed(order):
            own = [int(sizes[i]) for i in node.ends] + [x for c in node.children for x in (c.least, c.most)]
            node.least, node.most = min(own, default=0), max(own, default=0)


def needed(a, b, percent: int = PERCENT):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def trie_links(sets: list[np.ndarray], percent: int = PERCENT, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For every set, the sets that link with it; of a pair of chunks only links between both sides.

    sets: distinct hashes, no empty set. side: 0 or 1 for each set, or None where all pairs count.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(grams), np.uint32)
    rank[np.lexsort((grams, -df))] = np.arange(len(grams), dtype=np.uint32)
    ranks = rank[index]
    order = np.lexsort((owner, ranks))
    by_rank, starts = owner[order], np.searchsorted(ranks[order], np.arange(len(grams) + 1))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    root = Trie.of([np.sort(ranks[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    root.measure(sizes)
    # A node's children share its arrays; which sets can reach a child is told when the child is taken up.
    stack = [(root, np.zeros(len(sets), np.int32), np.arange(len(sets)), 0)]
    while stack:
        node, overlap, alive, depth = stack.pop()
        # What a set may still share is bounded by what remains of it and by what remains of the longest path.
        size, known = sizes[alive], overlap[alive]
        low = np.maximum(node.least, -(-percent * size // 100))
        reach = (known + np.minimum(size - known, node.most - depth) >= needed(size, low, percent)) & (low <= np.minimum(node.most, size * 100 // percent))
        if not reach.any():
            continue
        alive = alive[reach]
        depth += len(node.run)
        if len(node.run):
            a, b = starts[node.run], starts[node.run + 1]
            count = b - a
            at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            overlap = overlap + np.bincount(by_rank[at], minlength=len(sets)).astype(np.int32)
        for i in node.ends:
            found = alive[overlap[alive] >= needed(sizes[alive], sizes[i], percent)]
            yield i, found[(found != i) & (True if side is None else side[found] != side[i])]
        stack += [(child, overlap, alive, depth) for child in node.children]


def _block(rows: list[tuple], percent: int) -> pa.RecordBatch:
    """A task's classes with the smallest class that each is linked to, and each one's number of links."""
    nodes = np.array([r[0] for r in rows], np.int64)
    side = np.array([r[1] for r in rows], np.int64)
    sets = [np.frombuffer(r[2], "<u8") for r in rows]
    label, degree = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
    order = np.argsort(nodes)
    nodes, side, sets = nodes[order], side[order], [sets[i] for i in order]
    for i, found in trie_links(sets, percent, None if (side == side[0]).all() else side):
        degree[i] = len(found)
        if len(found):
            own = np.unique(np.append(label[found], label[i]))
            if len(own) > 1:
                label[np.isin(label, own[1:])] = own[0]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label]), pa.array(degree)], ["a", "b", "links"])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        key, held = None, []
        for batch in batches:
            for i, j, node, side, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != key and held:
                    large = len(held) > 500
                    yield _block(held, percent)
                    held = []
                    if large:
                        give_back()
                key = (i, j)
                held.append((node, side, own))
        if held:
            yield _block(held, percent)
        held = []
        give_back()

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                own = [s.tobytes() for s in shingle_sets(part.column("text"), n)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(own, pa.binary())], [*part.schema.names[:-1], "own"])

    return run


def _chunks(grams: int, most: int):
    """From classes by block and rarest member in order: each one's chunk, which ends with its block or at its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, last, held, n = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            out = []
            for block, size in zip(batch.column("block").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if n and (block != last or held + size > grams or n == most):
                    chunk, held, n = chunk + 1, 0, 0
                last, held, n = block, held + size, n + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("block"), batch.column("size"), pa.array(out, pa.int64())], ["node", "block", "size", "chunk"])

    return run


def _tasks(members: DataFrame, keyed: DataFrame, percent: int) -> DataFrame:
    """``node, i, j, side``: every class in its own chunk, and in each pair of its chunk with one that it may link into."""
    # Alone a chunk is one side; in a pair it is one of two.
    alone = members.select("node", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.lit(0).alias("side"))
    several = members.groupBy("block").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select("block")
    cut = materialise(members.join(several, "block", "left_semi").select("node", "chunk", "size"), "cut")
    found = cut.count()
    if not found:
        return alone
    few = F.broadcast(cut) if found <= BROADCAST_CLASSES else cut
    shared = keyed.select(F.col("doc_id").alias("node"), "prefix").join(few, "node").select(F.posexplode("prefix").alias("p", "gram"), "node", "chunk", "size")
    # The first member that two classes share has all others behind it in both: the largest size that a class may link with there.
    shared = shared.select("gram", "node", "chunk", "size", F.expr(f"({100 + percent} * (size - p)) div {percent} - size").alias("most"))
    places = shared.groupBy("gram", "chunk").agg(F.min("size").alias("size"), F.max("most").alias("most"), F.count(F.lit(1)).alias("n"))
    met = places.groupBy("gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "size", "most")).alias("places")).where("size(places) > 1")
    met = materialise(met.select("gram", "places", (F.col("n") * F.size("places") <= PAIR_ROWS).alias("each")), "met")
    near = "size <= p.most AND p.size <= most"
    each = shared.join(met.where("each").select("gram", "places"), "gram").select("node", "chunk", "size", "most", F.explode("places").alias("p"))
    each = each.where(f"chunk != p.chunk AND {near}").select("node", F.least("chunk", "p.chunk").alias("i"), F.greatest("chunk", "p.chunk").alias("j"), (F.col("chunk") > F.col("p.chunk")).cast("int").alias("side"))
    whole = met.where("NOT each").select(F.explode("places").alias("own"), "places").select("own.*", F.explode("places").alias("p"))
    whole = whole.where(f"chunk < p.chunk AND {near}").select(F.col("chunk").alias("i"), F.col("p.chunk").alias("j")).distinct()
    sides = F.explode(F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side")))).alias("s")
    whole = cut.join(whole.select("i", "j", sides).select("s.chunk", "i", "j", "s.side"), "chunk").select("node", "i", "j", "side")
    return alone.unionByName(each.unionByName(whole).distinct())


def _links(rows: DataFrame, tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, links`` of all tasks; where they take many times the sets, of some at a time, so that disk holds what those take."""
    spark, tasks_at_once = rows.sparkSession, partitions(rows.sparkSession)
    found, sent, grams = (x or 0 for x in tasks.select(F.sum(F.size("deals")), F.sum(F.size("deals") * F.col("size")), F.sum("size")).first())
    rounds = max(1, math.ceil(sent / max(1, ROUND * grams)))
    side = F.broadcast(tasks.drop("size")) if found <= BROADCAST_CLASSES else tasks.drop("size")
    clear_shuffles(spark)
    made = rows.join(side, F.col("doc_id") == F.col("node")).select("deals", "node", "text").mapInArrow(_sets(n), "deals array<struct<i: long, j: long, side: int>>, node long, own binary")
    if rounds > 1:
        made = materialise(made, "sets")
    out = []
    for k in range(rounds):
        dealt = made.withColumn("deals", F.filter("deals", lambda d: F.pmod(F.xxhash64(d["i"], d["j"]), F.lit(rounds)) == k)) if rounds > 1 else made
        dealt = dealt.select(F.explode("deals").alias("_d"), "node", "own").select("_d.i", "_d.j", "node", "_d.side", "own")
        sets = dealt.repartition(tasks_at_once, "i", "j").sortWithinPartitions("i", "j")
        out.append(materialise(sets.mapInArrow(_linked(percent), "a long, b long, links long"), "linked"))
        del dealt, sets
        clear_shuffles(spark)
    return reduce(DataFrame.unionByName, out)


CLASSES = "doc_id, n_shingles, class_id, links, component_id"


def jaccard_classes(docs: DataFrame, n: int = N, percent: int = PERCENT, block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per row of docs with an id: doc_id, ``n_shingles``, ``class_id``, ``links``, ``component_id``.

    ``class_id`` is the smallest doc_id with the same set, ``links`` the number of other classes that it links with.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    if not _repeats(rows):
        return _classes(rows, n, percent, block_grams, block_sets).selectExpr(*CLASSES.split(", "))
    own = materialise(rows.select(F.monotonically_increasing_id().alias("_n"), F.col("doc_id").alias("_id"), "text"), "numbered")
    return _numbered(own, n, percent, block_grams, block_sets).withColumnRenamed("_id", "doc_id").selectExpr(*CLASSES.split(", "))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def _numbered(own: DataFrame, n: int, percent: int, block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """For rows with numbers of their own (``_n``) beside ids that repeat: classes and components go by their smallest ids."""
    found = _classes(own.select(F.col("_n").alias("doc_id"), "text"), n, percent, block_grams, block_sets)
    found = materialise(own.select("_n", "_id").join(found, F.col("_n") == F.col("doc_id")).select("_n", "_id", *CLASSES.split(", ")[1:]), "numbered-classes")
    count = found.count()
    for name in ("class_id", "component_id"):
        least = found.groupBy(name).agg(F.min("_id").alias(f"_{name}"), F.count(F.lit(1)).alias("_rows"))
        found = spread_join(found, least, name, "_rows", count).drop(name, "_copy", "_rows").withColumnRenamed(f"_{name}", name)
    return found


def _classes(rows: DataFrame, n: int, percent: int, block_grams: int, block_sets: int) -> DataFrame:
    """For ids that occur once."""
    spark = rows.sparkSession
    bounded_batches(spark)
    tasks_at_once = partitions(spark)
    level = spark.sparkContext.broadcast(zlib.compress(commonness(rows, n).tobytes(), 1))
    give_back()
    info = materialise(rows.mapInArrow(_describe(level, n, percent), INFO), "shingles")
    keyed = info.where("n_shingles > 0")
    classes = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"))
    standing = keyed.select("doc_id", "n_shingles", "prefix").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    grams = standing.select(F.explode("prefix").alias("gram"), F.col("n_shingles").alias("size"), F.col("doc_id").alias("node"))
    chained = grams.repartition(tasks_at_once, "gram").sortWithinPartitions("gram", "size", "node").mapInArrow(_chains(percent), "a long, b long")
    blocks = components(chained).select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    sized = materialise(blocks.join(keyed.select("doc_id", F.col("n_shingles").alias("size"), F.col("prefix")[0].alias("rarest")), "doc_id").withColumnRenamed("doc_id", "node"), "blocks")
    sized = sized.repartitionByRange(tasks_at_once, "block", "rarest", "node").sortWithinPartitions("block", "rarest", "node")
    members = materialise(sized.select("node", "block", "size").mapInArrow(_chunks(block_grams // 2, max(1, block_sets // 2)), "node long, block long, size long, chunk long"), "members")
    tasks = _tasks(members, keyed, percent).groupBy("node").agg(F.collect_list(F.struct("i", "j", "side")).alias("deals"))
    tasks = materialise(tasks.join(members.select("node", "size"), "node"), "tasks")
    linked = _links(rows, tasks, n, percent)
    joined = components(linked.select("a", "b"))
    degree = linked.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("_links"))
    reached = classes.join(joined.select(F.col("node").alias("class_id"), "component"), "class_id", "left").join(degree, "class_id", "left")
    out = info.select("doc_id", "n_shingles", "k1", "k2").join(reached.select("k1", "k2", "class_id", "component", "_links"), ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"),
    )


def representatives(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, without those that are linked to a document with a smaller doc_id.

    Rows without an id stay; of rows that share an id each goes or stays by its own links.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    again = _repeats(rows)
    if again:
        kept = materialise(docs.select(F.monotonically_increasing_id().alias("_n"), F.struct(*docs.columns).alias("_row")), "numbered")
        own = kept.select("_n", F.col("_row.doc_id").cast("long").alias("_id"), F.col("_row.text").alias("text")).where("_id IS NOT NULL")
        drop = _numbered(own, n, percent).where("component_id != _id").select(F.col("_n").alias("_drop"))
    else:
        drop = jaccard_classes(docs, n, percent).where("component_id != doc_id").select(F.col("doc_id").alias("_drop"))
    drop = materialise(drop, "linked-away")
    if drop.count() <= BROADCAST_CLASSES:
        drop = F.broadcast(drop)
    if again:
        return kept.join(drop, kept["_n"] == drop["_drop"], "left_anti").select("_row.*")
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_drop"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), k AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(s)) ELSE doc_id END AS k FROM s
), e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c
), r AS (
  SELECT doc_id, doc_id AS k FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.k = e.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, k.k AS class_id, coalesce(l.n, 0)::BIGINT AS links, m.k AS component_id
FROM s JOIN (SELECT doc_id, min(k) AS k FROM r GROUP BY doc_id) m USING (doc_id) JOIN k USING (doc_id)
LEFT JOIN (SELECT x.k AS k, count(DISTINCT y.k) AS n FROM e JOIN k x ON e.a = x.doc_id JOIN k y ON e.b = y.doc_id WHERE x.k <> y.k GROUP BY x.k) l ON l.k = k.k
"""
