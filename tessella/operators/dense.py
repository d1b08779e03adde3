"""Dense retrieval (E4, J4, M3, M4, W6, A5-A9, T6, T7): exact top-k by blocks of queries, then the mean of the best chunks.

Queries are few (a profile's chunks). They go to the workers in blocks of ``block``, and each Arrow batch of stored vectors
is multiplied with a block at once; a batch passes on its best k for each query, so what is shuffled is k rows per query
and batch, not all pairs. Vectors are scaled to length one as they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_QUERIES = 100_000
#: More than the rounding of a matrix product of unit vectors.
SLACK = 1e-9


def similarity(distance: Column) -> Column:
    """M3: cosine distance to similarity within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def unit(vectors: np.ndarray) -> np.ndarray:
    """M4: rows of length one; zero rows stay zero."""
    n = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine similarities within 0 and 1, each summed from the first component to the last: the same two vectors give the same
    bits wherever they stand. Zero vectors have 0."""
    total = lambda products: np.cumsum(products, axis=-1)[..., -1]
    n = np.sqrt(total(query * query) * total(vectors * vectors))
    return np.clip(np.divide(total(vectors * query), n, out=np.zeros(len(vectors)), where=n > 0), 0.0, 1.0)


def top_hits(queries: DataFrame, store: DataFrame, *, k: int = 25, query_id: str = "query_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, the store's columns but its vector, similarity, hit): the k nearest stored rows of each query; ties by
    the ``ordinal`` column. The queries are collected, at most ``MOST_QUERIES``."""
    rows = queries.select(query_id, vector).orderBy(query_id).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; pass them in parts")
    kept = store.drop(vector)
    id_type = to_arrow_type(queries.schema[query_id].dataType)
    kind = dict(queries.dtypes)[query_id]
    schema = ", ".join([f"{query_id} {kind}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "similarity double"])

    def of(part: list) -> DataFrame:
        raw = np.array([r[vector] for r in part], float)
        matrix = unit(raw)
        ids = [r[query_id] for r in part]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                usable = np.flatnonzero([v is not None for v in batch.column(vector).to_pylist()]) if batch.column(vector).null_count else np.arange(batch.num_rows)
                if not len(usable):
                    continue
                batch = batch.take(pa.array(usable)) if len(usable) < batch.num_rows else batch
                values = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                sims = np.clip(matrix @ unit(values).T, 0.0, 1.0)
                order = batch.column("ordinal").to_numpy(zero_copy_only=False)
                few = min(k, batch.num_rows)
                # a product's last digits depend on the place in the batch: all rows near the k-th are measured anew, so equal
                # vectors have equal similarities and ties are settled by ordinal
                limit = -np.partition(-sims, few - 1, axis=1)[:, few - 1] - SLACK
                q_at, s_at, found = [], [], []
                for q in range(len(ids)):
                    near = np.flatnonzero(sims[q] >= limit[q])
                    exact = cosines(raw[q], values[near])
                    best = np.lexsort((order[near], -exact))[:few]
                    q_at += [q] * len(best)
                    s_at += near[best].tolist()
                    found += exact[best].tolist()
                take = pa.array(s_at, pa.int64())
                names = [n for n in batch.schema.names if n != vector]
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in q_at], id_type), *(batch.column(n).take(take) for n in names), pa.array(found, pa.float64())], [query_id, *names, "similarity"])

        return store.select(*kept.columns, vector).mapInArrow(run, schema)

    if not rows:
        return store.limit(0).drop(vector).select(F.lit(None).cast(kind).alias(query_id), *kept.columns, F.lit(0.0).alias("similarity"), F.lit(1).alias("hit"))
    found = reduce(DataFrame.unionByName, [of(rows[i : i + block]) for i in range(0, len(rows), block)])
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), "ordinal")
    return found.withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= k)


def aggregate_hits(hits: DataFrame, *, best: int = 3) -> DataFrame:
    """(slug, matched_chunks, similarity, score, best_chunk): the mean of the at most ``best`` highest chunk maxima.
    Only matched chunks count, any hit matches, rows without a slug are left out (P14)."""
    kept = hits.where(F.col("slug").isNotNull() & (F.col("slug").cast("string") != ""))
    chunk = kept.groupBy("slug", "chunk_index").agg(F.max("similarity").alias("s"), F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy("slug").orderBy(F.desc("s"), "ordinal")
    ranked = chunk.withColumn("r", F.row_number().over(w))
    mean = F.avg(F.when(F.col("r") <= best, F.col("s")))
    return ranked.groupBy("slug").agg(F.count(F.lit(1)).alias("matched_chunks"), mean.alias("similarity"), F.bround(mean * 100, 1).alias("score"), F.min_by("chunk_index", "r").alias("best_chunk"))


def rank_dense(queries: DataFrame, store: DataFrame, *, fanout: int = 25, best: int = 3, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """E4, A8, T-1: one row per slug with a hit; ``store`` has slug, chunk_index, ordinal and the vector."""
    scored = aggregate_hits(top_hits(queries, store, k=fanout, query_id=query_id, vector=vector), best=best)
    total = store.groupBy("slug").agg(F.count(F.lit(1)).alias("total_chunks"))
    return scored.join(total, "slug", "left")


def ranked(ranking: DataFrame, *keys: str) -> DataFrame:
    """T-1, W8: position by the rounded score, then the slug; the sort is global, so it is for a ranking's few rows."""
    return ranking.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "slug")))
