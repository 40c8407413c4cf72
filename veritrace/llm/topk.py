"""Exact top-k search by inner product: tiles of vectors, searched dimension block by dimension block with bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import map_arrow, slices
from veritrace.llm.registry import query
from veritrace.session import materialize

#: Queries and candidates of a tile, on average. A task holds the queries; candidates stream by.
TILE_QUERIES, TILE_ROWS = 16_384, 1 << 20
#: Candidates that are searched together, and dimensions that are added before candidates are dropped.
CHUNK, BLOCK = 8192, 8
#: Rows that one task sends on at a time.
SEND = 50_000
#: Scores beyond a long are given as its ends.
LEAST, MOST = -(2**63), 2**63 - 1


def remaining(rows: np.ndarray) -> np.ndarray:
    """Per block of dimensions: the length of what stands in it and the later ones, rounded up. The last row is zero."""
    squares = np.add.accumulate((rows.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    return np.vstack([np.sqrt(squares[e]) * (1 + 1e-9) for e in range(0, len(rows), BLOCK)] + [np.zeros(rows.shape[1])])


class Search:
    """The ``k`` best rows for each of some queries, among rows that are fed in any order.

    Vectors stand in vertical layout, one array a dimension. Partial sums grow block by block over all candidates that are
    left; what a candidate can still gain or lose is at most the product of both remaining lengths, and a candidate whose
    best case lies under the k-th best sure score goes.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.order = np.argsort(-np.abs(vectors.astype(np.float64)).sum(axis=0), kind="stable")  # heavy dimensions first
        self.rows = np.ascontiguousarray(vectors[:, self.order].T)
        self.rest = remaining(self.rows)
        self.peak = float(np.abs(self.rows.astype(np.float64)).max(initial=0))
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)

    def feed(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rows = np.ascontiguousarray(vectors[:, self.order].T)
        peak = self.peak * float(np.abs(rows.astype(np.float64)).max(initial=0)) * max(len(rows), 1)
        kind = np.float64 if peak < 2**52 else np.int64 if peak < 2**62 else object  # each is exact in its range
        rest, rows, queries = remaining(rows), rows.astype(kind), self.rows.astype(kind)
        for start in range(0, len(self.ids), 256):
            first = queries[:BLOCK, start:start + 256].T @ rows[:BLOCK]
            for place in range(start, min(start + 256, len(self.ids))):
                self._one(place, queries[:, place], first[place - start], ids, rows, rest)

    def _one(self, place, query, partial, ids, rows, rest) -> None:
        k, before = self.k, self.scores[place]
        left = np.flatnonzero(ids != self.ids[place])
        partial = partial[left]
        for block in range(1, len(rest)):
            if len(left) > k:
                gain = self.rest[block, place] * rest[block][left]
                known = partial.astype(np.float64)
                slack = 1e-9 * (np.abs(known) + gain) + 1e-6  # more than float rounding can lose
                sure = np.concatenate([known - gain - slack, before.astype(np.float64)])
                stay = known + gain + slack >= np.partition(sure, len(sure) - k)[len(sure) - k]
                if not stay.all():
                    left, partial = left[stay], partial[stay]
            if block < len(rest) - 1:
                a, b = block * BLOCK, (block + 1) * BLOCK
                partial = partial + query[a:b] @ rows[a:b, left]
        scores = np.concatenate([before, partial if partial.dtype == object else partial.astype(np.int64)])
        found = np.concatenate([self.found[place], ids[left]])
        if scores.dtype == object:
            top = np.array(sorted(range(len(found)), key=lambda i: (-scores[i], found[i]))[:k], dtype=np.int64)
        else:
            top = np.lexsort((found, -scores))[:k]
        self.scores[place], self.found[place] = scores[top], found[top]

    def best(self) -> Iterator[tuple[int, int, int]]:
        for name, scores, found in zip(self.ids.tolist(), self.scores, self.found, strict=True):
            for score, row in zip(scores.tolist(), found.tolist(), strict=True):
                yield name, row, min(max(score, LEAST), MOST)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (floor of scale times each component, as long), once for each pair of id and vector that takes part."""
    fine = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).distinct()


def top_k(
    df: DataFrame, every: int, k: int, *, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row whose id is divisible by ``every``.

    Gives query_id, rank (from 1), vec_id, score. Queries and candidates are dealt over a grid of tiles by their ids, so
    no task sees more than a tile, and the tiles' lists are merged by query. Nothing is broadcast.

    Rows with a null id or a vector that is null or holds a null, NaN or infinity take no part; a row that repeats id and
    vector counts once; rows with the query's id are no candidates of it, and a query id with several vectors is
    searched by each of them, with ranks over all. Vectors of different lengths never meet. An empty vector scores 0.
    Scores beyond a long are given as its ends. Ties go to the smaller id. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = materialize(whole_vectors(df, id_col, vector_col, scale).withColumn("dims", F.size("v")), "whole-vectors")
    asks = F.col("id") % every == 0
    n = rows.agg(F.count(F.lit(1)), F.count_if(asks)).first()
    down, across = math.ceil(max(n[1], 1) / TILE_QUERIES), math.ceil(max(n[0], 1) / TILE_ROWS)
    slots = df.sparkSession.sparkContext.defaultParallelism
    across = max(across, min(math.ceil(slots / down), math.ceil(max(n[0], 1) / 512)))  # small tables use all slots, too
    deal = F.xxhash64("id", "v")
    q = rows.where(asks).select(
        F.lit(0).alias("role"), "id", "v", "dims", F.pmod(deal, F.lit(down)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    c = rows.select(
        F.lit(1).alias("role"), "id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"),
        F.pmod(deal, F.lit(across)).cast("int").alias("j"))
    tile = (F.col("i") * across + F.col("j")).alias("tile")
    tiles = q.select(tile, "dims", "role", "id", "v").unionByName(c.select(tile, "dims", "role", "id", "v"))
    dealt = tiles.repartitionById(down * across, F.col("tile")).sortWithinPartitions("tile", "dims", "role")

    def run(batches):
        at = search = None
        asked: list[tuple] = []

        def done():
            out = []
            for row in search.best() if search is not None else ():
                out.append(row)
                if len(out) >= SEND:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        for batch in slices(batches, CHUNK):
            tile_of, dims, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((np.diff(tile_of) != 0) | (np.diff(dims) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if at != (tile_of[a], dims[a]):
                    yield from done()
                    at, search, asked = (tile_of[a], dims[a]), None, []
                part = batch.slice(a, b - a)
                ids = part.column(3).to_numpy()
                vectors = part.column(4).flatten().to_numpy().reshape(b - a, dims[a])
                if asks[a] == 0:  # a tile's queries come before its candidates
                    asked.append((ids, vectors))
                elif asked:
                    search = search or Search(*(np.concatenate(x) for x in zip(*asked, strict=True)), k)
                    search.feed(ids, vectors)
        yield from done()

    lists = map_arrow(dealt, run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])


ORACLE = """
with fine as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as hugeint)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as score
    from fine q join fine c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 10
"""


@query("op13_top_k", ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)
