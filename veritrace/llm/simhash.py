"""SimHash near-duplicates: fingerprints, a trie self-join within a Hamming budget, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import documents, map_arrow, salted_join, slices, spread_keys
from veritrace.llm.registry import query
from veritrace.session import materialize

SEED = 42
#: A block with more members than this is cut into pieces of half as many, and each pair of pieces is compared by itself.
BLOCK_ROWS = 32768
#: Node pairs of at most this many fingerprint pairs are compared directly.
LEAF_PAIRS = 4096


def hashes(parts: list[bytes]) -> np.ndarray:
    one = xxhash.xxh64_intdigest
    return np.array([one(p, SEED) for p in parts], dtype=np.uint64)


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words, repeats included, joined by a blank; the whole sequence when there are fewer words."""
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= size:
        return [text]
    starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    return [text[a:b] for a, b in zip(starts[:-size].tolist(), (starts[size:] - 1).tolist(), strict=True)]


def majority(values: np.ndarray) -> np.uint64:
    """The bits set in over half of the values."""
    data = values.view(np.uint8).reshape(len(values), 8)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(data), 255):
        count += np.add.reduce(np.unpackbits(data[at:at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(count * 2 > len(data), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, *, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``_id``, ``sig`` (hash of the text) and ``fp``, the 64-bit SimHash of its word shingles.

    A-Z are lower-cased. A text without a word has 0. Null texts are empty ones.
    """
    source = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"), F.col(text_col).alias("_text"))

    def run(batches):
        for batch in slices(batches):
            fps = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                fps.append(majority(hashes(shingles(words, size))) if words else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["_id", "sig", "fp"])

    return map_arrow(source, run, f"_id {dict(source.dtypes)['_id']}, sig long, fp long")


class Clusters:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def node_pairs(values: np.ndarray, budget: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of the sorted values whose pairs may lie within the budget.

    The sorted values are the leaves of a binary trie, a node is a range with a common prefix. The trie is traversed
    against itself: each pair of nodes carries the bits in which their prefixes differ and is dropped once these
    exceed the budget.
    """
    stack = [(0, len(values), 0, len(values), 63, 0)]
    while stack:
        a0, a1, b0, b1, bit, differ = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= LEAF_PAIRS:
            yield a0, a1, b0, b1
            continue
        if bit < 0:  # equal values
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            stack += [(a0, am, b0, bm, bit, differ), (am, a1, bm, b1, bit, differ), (a0, am, bm, b1, bit, differ)]
            if (a0, a1) != (b0, b1):
                stack.append((am, a1, b0, bm, bit, differ))
            continue
        below = (1 << (bit + 1)) - 1
        middle = [
            lo + int(np.searchsorted(values[lo:hi], np.uint64((int(values[lo]) & ~below) | 1 << bit)))
            for lo, hi in ((a0, a1), (b0, b1))
        ]
        am, bm = middle
        stack.append((a0, am, b0, bm, bit - 1, differ))
        stack.append((am, a1, bm, b1, bit - 1, differ))
        if differ < budget:
            stack.append((a0, am, bm, b1, bit - 1, differ + 1))
            if (a0, a1) != (b0, b1):
                stack.append((am, a1, b0, bm, bit - 1, differ + 1))


def block_links(values: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that connect the members of a block as all its links would: one less than the members of each component."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    clusters, links = Clusters(len(values)), []
    for a0, a1, b0, b1 in node_pairs(values, budget):
        close = np.bitwise_count(values[a0:a1, None] ^ values[None, b0:b1]) <= budget
        left, right = np.nonzero(np.triu(close, 1) if a0 == b0 else close)
        for i, j in zip((left + a0).tolist(), (right + b0).tolist(), strict=True):
            if clusters.join(i, j):
                links.append((int(order[i]), int(order[j])))
    return links


def _pieces(p: Column, own: Column) -> Column:
    """Numbers of the pairs of ``p`` pieces that piece ``own`` is in."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), p - 1), lambda j: j != own)
    return F.when(p == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda j: F.least(own, j) * p + F.greatest(own, j)))


def dealt(nodes: DataFrame, keys: list[Column]) -> DataFrame:
    """``nodes`` once for each of ``keys``, as ``key``; what shares one is compared in one task.

    A key of over ``BLOCK_ROWS`` nodes is cut into pieces by a hash of the node and dealt as pairs of pieces, so that a
    member is sent once for every other piece and any two members still meet, however alike they are.
    """
    rows = nodes.select("*", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select(
        "key", F.ceil(F.col("count") * 2 / BLOCK_ROWS).alias("_p"))
    hot = materialize(hot, "hot-blocks")
    if hot.isEmpty():
        return rows
    # one row for BLOCK_ROWS dealt nodes at most
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("_p", F.coalesce("_p", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("_p"))
    rows = rows.withColumn("_pair", F.explode(_pieces(F.col("_p"), own)))
    return rows.withColumn("key", F.xxhash64("key", "_pair")).drop("_p", "_pair")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, sorted by ``key``, in tables that hold each key whole."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = held["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None:
        yield held


def several(table: pa.Table) -> list[tuple[int, int]]:
    """Ranges of rows with the same key, of two rows or more."""
    key = table["key"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.array([], dtype=np.int64)
    ends = np.append(starts[1:], len(key))
    return [(lo, hi) for lo, hi in zip(starts.tolist(), ends.tolist()) if hi - lo > 1]


def near_links(nodes: DataFrame, budget: int) -> DataFrame:
    """Links ``a``, ``b`` between nodes (``node``, ``fp``) whose fingerprints differ in at most ``budget`` bits.

    Nodes are dealt by ``budget + 1`` blocks of the bits of ``fp``: two values that differ in at most ``budget`` bits agree
    in one. Within a block only links that join two components are returned, so that a group of copies gives as many
    links as members, not as pairs; the components are those of all links.
    """
    edges = [round(i * 64 / (budget + 1)) for i in range(budget + 2)]
    keys = [
        F.xxhash64(F.lit(lo), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        for lo, hi in zip(edges, edges[1:])]

    def run(batches):
        for table in groups(batches):
            node, fp = table["node"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            a, b = [], []
            for lo, hi in several(table):
                for i, j in block_links(fp[lo:hi], budget):
                    a.append(int(node[lo + i]))
                    b.append(int(node[lo + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = dealt(nodes.select("node", "fp"), keys).select("key", "node", "fp").repartition("key").sortWithinPartitions("key")
    return map_arrow(rows, run, "a long, b long").where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node with a link.

    Stars are contracted in turn: every node hands its larger neighbours to its smallest one, then its smaller ones,
    until nothing changes. Each round is a written table, so a lost executor costs at most one round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def near_components(prints: DataFrame, budget: int) -> DataFrame:
    """``prints`` with ``first``, the smallest (``_id``, ``sig``) of each row's component.

    Rows with equal fingerprints are one node. Their number and the number of nodes in a component have no bound: both
    are pre-aggregated, and hot ones are dealt over tasks when rows get their component back.
    """
    prints = materialize(prints.withColumn("node", F.xxhash64("fp")), "fingerprints")
    nodes = materialize(
        prints.groupBy("node").agg(F.min(F.struct("_id", "sig")).alias("first"), F.count(F.lit(1)).alias("rows"), F.min("fp").alias("fp")), "nodes")
    roots = components(near_links(nodes, budget))
    linked = nodes.select("node", "first").join(roots, "node")
    linked = linked.union(nodes.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").select("node", "first", F.col("node").alias("root")))
    linked = materialize(linked, "linked-nodes")
    firsts = linked.groupBy("root").agg(F.min("first").alias("component_first"), F.count(F.lit(1)).alias("n"))
    hot_roots = spread_keys(firsts, "root", "n", linked.count())
    found = salted_join(linked.select("root", "node"), firsts.select("root", "component_first"), "root", "node", hot_roots)
    of_node = nodes.select("node", F.col("first").alias("own")).join(found.select("node", "component_first"), "node", "left")
    of_node = of_node.select("node", F.coalesce("component_first", "own").alias("first"))
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    return salted_join(prints, of_node, "node", "_id", spread_keys(nodes, "node", "rows", total))


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


@query("op7_simhash_components")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(fingerprints(documents(spark, sf_dir), size=3), budget=3)
    return found.select(F.col("_id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), F.col("first._id").alias("component_id"))


def keep_one(docs: DataFrame, *, size: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their near-duplicate group; of repeated rows one stays.

    Two rows are linked if the SimHashes of their runs of ``size`` words differ in at most ``budget`` bits; a group is what
    links connect, and its row with the smallest id stays, a null id first (among equal ids the smaller text hash).
    Null and empty texts are one group. Columns of any name are kept: a row travels as one struct. Whole rows are
    shuffled once, after equal ones were put together.
    """
    kept = near_components(fingerprints(docs, size=size, id_col=id_col, text_col=text_col), budget)
    kept = kept.select(F.col("first").alias("_key")).distinct()
    sig = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("_id"), sig.alias("sig")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    return rows.groupBy("_key").agg(F.first("_whole").alias("_whole")).join(kept, "_key", "left_semi").select("_whole.*")
