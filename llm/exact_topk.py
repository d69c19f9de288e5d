"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates and queries are dealt into blocks of bounded size, and each pair of blocks is one task
group, so neither side is ever broadcast or collected.  A candidate block keeps, per dimension, the
list of its rows in order of that component.  For a query, the lists are read from the end its sign
favours, a batch of depth at a time; rows met for the first time are scored in full; the threshold is
the score that a row could have whose every component is no better than the last ones read.  Reading
stops when the threshold is below the k-th best score so far: then no unread row can enter, not even
as a tie.  Blocks' results are merged by rank.

Defined results: vectors that are null or hold a null or non-finite component take no part; scores
compare vectors of one length only; equal scores go to the smaller id, equal ids are ranked in any
order; rows with a null id take no part; components are floor(scale * x); sums of products must stay
below 2**63 (ValueError otherwise).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024
TOP = "query_id long, vec_id long, score long"


class SortedLists:
    """A block of candidates with its rows in order of every component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)  # ascending, a column per dimension
        self.ordered = np.take_along_axis(self.vectors, self.lists, axis=0)

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score), best first, leaving out rows with the query's own id."""
        n = len(self.ids)
        dims = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        seen[self.ids == query_id] = True
        best_rows, best = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        up = query[dims] > 0
        at, depth = 0, min(n, max(32, n // 64))
        while at < n:
            to = min(n, at + depth)
            if len(dims):
                ahead, behind = self.lists[n - to : n - at][:, dims[up]], self.lists[at:to][:, dims[~up]]
                met = np.zeros(n, bool)
                met[ahead.ravel()] = True
                met[behind.ravel()] = True
                fresh = np.flatnonzero(met & ~seen)
                bound = int(query[dims[up]] @ self.ordered[n - to, dims[up]]) + int(query[dims[~up]] @ self.ordered[to - 1, dims[~up]])
            else:
                fresh, bound, to = np.flatnonzero(~seen), -1, n
            seen[fresh] = True
            rows = np.concatenate([best_rows, fresh])
            scores = np.concatenate([best, self.vectors[fresh] @ query])
            if len(rows) > k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = np.flatnonzero(scores >= cut)
                rows, scores = rows[near], scores[near]
                order = np.lexsort((rows, -scores))[:k]  # rows are in order of id
                rows, scores = rows[order], scores[order]
            best_rows, best = rows, scores
            at, depth = to, depth * 2
            if len(best) >= k and (bound < best.min() or seen.all()):
                break
        order = np.lexsort((best_rows, -best))
        return [(int(self.ids[r]), int(s)) for r, s in zip(best_rows[order], best[order], strict=True)]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers; as doubles while sums of products are exact in them, which is faster."""
    column = column.combine_chunks()
    flat = np.concatenate([c.flatten().to_numpy() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]) if len(column) else np.zeros(0, np.int64)
    return flat.reshape(-1, dims)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best among all other rows."""
    usable = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).withColumn("__q", is_query)
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = usable.where(finite).select(F.col(vec_id).cast("long").alias("id"), whole.alias("v"), F.size(vector).alias("dims"), F.coalesce("__q", F.lit(False)).alias("q"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, parts = max(1, -(-sizes.n // block_rows)), max(1, -(-sizes.q // query_rows))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    candidates = rows.select("id", "v", "dims", spread(blocks).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    queries = rows.where("q").select("id", "v", "dims", spread(parts).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dims = left.column("dims")[0].as_py()
            a, b = _matrix(left.column("v"), dims), _matrix(right.column("v"), dims)
            most = (float(np.abs(a).max()) * float(np.abs(b).max()) * dims) if dims else 0.0
            if most >= 2.0**63:
                raise ValueError("scores do not fit 64 bits")
            if most < 2.0**52:
                a, b = a.astype(float), b.astype(float)
            lists = SortedLists(left.column("id").to_numpy(), a)
            for query_id, query in zip(right.column("id").to_pylist(), b, strict=True):
                out += [(query_id, *hit) for hit in lists.top(query_id, query, k)]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = candidates.groupBy("c", "p", "dims").cogroup(queries.groupBy("c", "p", "dims")).applyInArrow(search, TOP)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
