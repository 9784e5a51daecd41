"""Exact top-k inner-product search with the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.scratch import written
from matchloom.session import table

#: Vectors and queries that one task holds at a time.
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 4096
#: Places by which the lists are read further, at first; it doubles from round to round.
FIRST_DEPTH = 16

RESULT = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for a vector that is null or holds null or non-finite values."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector's missing components are 0."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class SortedLists:
    """Per-dimension lists of a block's vectors, from which any query reads its best contributions first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        columns = np.ascontiguousarray(self.vectors.T)
        self.lists = np.argsort(columns, axis=1, kind="stable")  # ascending; read from the end for positive weights
        self.values = np.take_along_axis(columns, self.lists, axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
        """The k best (vec_id, score) other than the query's own rows, ties to the smaller id; and the vectors scored.

        Every list is read to the same depth. What an unseen vector can score at most is the sum of the contributions
        at that depth; reading stops when that is below the kth best score or the floor, or when every vector has been
        seen. floor: a score that k other vectors are known to reach; answers below it may be left out.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == query_id
        if not len(up) + len(down):
            return [(int(i), 0) for i in self.ids[~seen][:k]], 0
        best: list[tuple[int, int]] = []
        own = int(seen.sum())
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            met[self.lists[up, n - upto : n - depth].ravel()] = True
            met[self.lists[down, depth:upto].ravel()] = True
            fresh = np.flatnonzero(met & ~seen)
            if len(fresh):
                seen |= met
                scores = self.vectors[fresh] @ query
                if len(fresh) > k:
                    kth = np.partition(scores, -k)[-k]
                    fresh, scores = fresh[scores >= kth], scores[scores >= kth]
                    if len(fresh) > k:  # equal scores: rows stand by id
                        fresh, scores = (x[np.argsort(-scores, kind="stable")[:k]] for x in (fresh, scores))
                best = sorted(best + [(-int(s), int(i)) for s, i in zip(scores, self.ids[fresh])])[:k]
            depth, step = upto, 2 * step
            bound = self.values[up, n - depth] @ query[up] + self.values[down, depth - 1] @ query[down]
            if bound < floor or len(best) == k and bound < -best[-1][0] or seen.all():
                break
        return [(i, -s) for s, i in best], int(seen.sum()) - own


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products among all vectors but its own: query_id, rank, vec_id, score.

    Vectors and queries are dealt into blocks of bounded size; a task holds one block of each, searches it with the
    threshold algorithm, and returns at most k rows per query; the best k of those are the answer. The first block of
    vectors is searched first: the kth score that a query finds there is its floor in all other blocks, which stop reading
    once they cannot reach it. The vectors are copied once per block of queries and the queries once per block of vectors.

    Left out: vectors that are null or hold null or non-finite components. Own rows: those with the query's id, so
    repeated rows of an id never answer it. Repeated rows of another id each take a rank, as do the answers of each
    repeated row of a query, all ranked together; equal rows are combined with their number before blocks are dealt. A null id is neither query nor candidate. Vectors of different lengths:
    missing components count as 0. Ties: smaller id. Fewer than k candidates: all. Empty tables: no rows.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v")).filter("id is not null and v is not null").groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))

    n_vectors, n_queries = vectors.count(), queries.count()
    v_blocks = max(1, -(-n_vectors // VECTORS_PER_BLOCK), min(6, n_vectors // 1024))
    q_blocks = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = usable(vectors).select("*", F.pmod(F.xxhash64("id", "v"), F.lit(v_blocks)).cast("int").alias("vb"), all_blocks(q_blocks).alias("qb"))
    asked = usable(queries).select("*", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)).cast("int").alias("qb"), all_blocks(v_blocks).alias("vb"))

    def search(base_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(base_rows) and len(query_rows):
            width = max(map(len, (*base_rows.v, *query_rows.v)))
            own, wanted = matrix(base_rows.v, width), matrix(query_rows.v, width)
            largest = width * float(np.abs(own).max(initial=0)) * float(np.abs(wanted).max(initial=0))
            exact = float if largest < 2**52 else np.int64 if largest < 2**62 else object  # whole numbers in each
            own, wanted = own.astype(exact), wanted.astype(exact)
            copies = base_rows.n.to_numpy()
            lists = SortedLists(np.repeat(base_rows.id.to_numpy(), copies), np.repeat(own, copies, axis=0))
            for query_id, n, floor, query in zip(query_rows.id.tolist(), query_rows.n.tolist(), query_rows.floor.tolist(), wanted):
                least = -np.inf if floor is None or floor != floor else int(floor)
                out += [(query_id, i, s) for i, s in lists.search(query_id, query, k, least)[0] for _ in range(n)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def searched(vectors: DataFrame, queries: DataFrame) -> DataFrame:
        return vectors.groupBy("vb", "qb").cogroup(queries.groupBy("vb", "qb")).applyInPandas(search, RESULT)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = searched(base.filter("vb = 0"), asked.filter("vb = 0").withColumn("floor", F.lit(None).cast("long")))
    if v_blocks > 1:
        found = written(found)
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        found = found.unionByName(searched(base.filter("vb > 0"), asked.filter("vb > 0").join(kth, "id", "left")))
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
