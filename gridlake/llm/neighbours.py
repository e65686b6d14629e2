"""Nearest neighbours of a stated query set by a block matrix join.

Queries come in groups of at most QUERY_GROUP vectors (the only thing that is broadcast), candidates stay where they are and are
taken in blocks. For a tile of queries and candidates the int8 codes' product gives squared distances with a bound on the
quantisation error: with x = s*c + e, |x.y - s*t*c.d| <= |s*c|*|f| + |e|*|y|. Pairs whose lower bound beats the k-th
upper bound so far are computed again in double precision on the original vectors, and each query's sorted lists are
merged by heaps. Every candidate's bound is looked at, so the neighbours are exact (recall 1).

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of other lengths than the query's are no candidates; ties go to the smaller id; a query's own id is no candidate;
repeated rows are candidates each, and a query id that stands on several rows is answered once, for the least of its vectors; no row with the
query's id is its candidate; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_GROUP = 32_768
QUERY_TILE = 512
BLOCK = 4096
MAX_EXACT = 1000  # longer vectors' products are summed in double


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id long and v array<double> of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    found = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return found.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


class Side:
    """Vectors with their int8 codes, and norms of codes and residues."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        self.scale = np.abs(vectors).max(axis=1) / 127
        codes = np.rint(vectors / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        rest = vectors - codes * self.scale[:, None]
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.code_norm = np.sqrt((codes * codes).sum(axis=1)) * self.scale
        self.rest_norm = np.sqrt((rest * rest).sum(axis=1))

    def rows(self, where) -> Side:
        part = object.__new__(Side)
        part.__dict__ = {k: x[where] for k, x in self.__dict__.items()}
        return part


def tile(q: Side, c: Side) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances; the int8 products' sums are exact in the float type used."""
    kind = np.float32 if q.codes.shape[1] <= MAX_EXACT else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T) * (q.scale[:, None] * c.scale[None, :])
    error = q.code_norm[:, None] * c.rest_norm[None, :] + q.rest_norm[:, None] * c.norm[None, :]
    near = (q.norm**2)[:, None] + (c.norm**2)[None, :] - 2 * product
    slack = 2 * error + 1e-9 * ((q.norm**2)[:, None] + (c.norm**2)[None, :]) + 1e-300
    return near - slack, near + slack


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed component by component."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        d = vectors[:, k] - query[k]
        total += d * d
    return np.sqrt(total)


def _search_task(group, k: int):
    def run(batches):
        ids, lists = group.value
        sides = {}
        for dim in {len(v) for v in lists}:
            mine = [i for i, v in enumerate(lists) if len(v) == dim]
            sides[dim] = (np.array([ids[i] for i in mine]), Side(np.array([lists[i] for i in mine], float)))
        best: dict[int, list[tuple[float, int]]] = {int(i): [] for i in ids}

        def block(of_ids, vectors):
            if vectors.shape[1] not in sides:
                return
            names, queries = sides[vectors.shape[1]]
            candidates = Side(vectors)
            for start in range(0, len(names), QUERY_TILE):
                part = queries.rows(slice(start, start + QUERY_TILE))
                low, high = tile(part, candidates)
                mine = names[start : start + QUERY_TILE]
                high[mine[:, None] == of_ids[None, :]] = np.inf  # rows with the query's own id, however many, are no candidates
                cut = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
                for j, name in enumerate(mine.tolist()):
                    now = best[name]
                    limit = min(cut[j], now[-1][0] ** 2 * (1 + 1e-9) + 1e-300) if len(now) == k else cut[j]
                    near = np.flatnonzero((low[j] <= limit) & (of_ids != name))
                    if len(near):
                        exact = distances(part.v[j], vectors[near])
                        order = np.lexsort((of_ids[near], exact))[:k]
                        best[name] = list(islice(heapq.merge(now, zip(exact[order].tolist(), of_ids[near][order].tolist())), k))

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                column = piece.column("v")
                sizes = column.value_lengths().to_numpy()
                flat, of_ids = column.flatten().to_numpy(zero_copy_only=False), piece.column("vec_id").to_numpy()
                begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for dim in np.unique(sizes):
                    mine = sizes == dim
                    block(of_ids[mine], flat[begin[mine][:, None] + np.arange(dim)[None, :]])
        rows = [(q, v, d) for q, found in best.items() for d, v in found]
        if rows:
            q, v, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank int, vec_id, score; both inputs as usable() gives them."""
    spark = candidates.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = max(1, math.ceil(queries.count() / (QUERY_GROUP * 0.9)))
    found = None
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g).toArrow()
        group = spark.sparkContext.broadcast((rows.column("vec_id").to_pylist(), rows.column("v").to_pylist()))
        part = candidates.mapInArrow(_search_task(group, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionAll(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    vectors = usable(embeddings, "vec_id", "embedding")
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
