"""Benchmark decontamination: size-partitioned MinHash containment search (operator 10, native).

Test items are short and documents long, so their Jaccard similarity is tiny and symmetric banding would miss them.
Instead only the items are sketched: items are partitioned by the power of two of their number u of distinct shingles,
and each keeps its k smallest shingle hashes, k = u - ceil(t * u) + 1 for the partition's largest u. A document that
contains the share t of an item lacks at most u - ceil(t * u) of its shingles, so at least one sketched hash is among
the document's: no such pair can be missed, whatever the document's length. Candidate documents are then verified by
exact containment of word shingles.

Defined results: words are lower-cased; a text of fewer than ``size`` words is one shingle; null and blank items have no
shingles and match nothing; an item id that repeats with several texts counts by the best of them, as does a repeated
document id; null document ids are reported as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import COPY, materialize, row_copy, same_row, words

SHINGLE = 5
THRESHOLD = 0.8


def _hashes(h: Column, size: int) -> Column:
    """Hashes of all shingles from the words' hashes. A shorter text is one shingle: nulls past its end add nothing."""
    last = F.greatest(F.size(h) - size, F.lit(0))
    return F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))


def _shingles(w: Column, size: int) -> Column:
    """Distinct shingles as text."""
    last = F.greatest(F.size(w) - size, F.lit(0))
    return F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))))


# explode_outer throughout: from explode Spark infers a filter size(array) > 0 and pushes it below the projections, which
# evaluates the arrays twice and, inside lambdas, once for every element.


def _hashed(df: DataFrame, text: str, size: int, *keep: str) -> DataFrame:
    split = df.select(*keep, words(F.lower(text)).alias("w"))
    return split.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("h")).select(*keep, _hashes(F.col("h"), size).alias("g"))


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, variant, n_shingles, shingle): variant numbers the texts of an item by their hash."""
    kept = items.select("item_id", F.xxhash64("text").alias("variant"), words(F.lower("text")).alias("w")).select("item_id", "variant", _shingles(F.col("w"), size).alias("s"))
    return kept.select("item_id", "variant", F.size("s").cast("long").alias("n_shingles"), F.explode_outer("s").alias("shingle")).where(F.col("shingle").isNotNull()).distinct()


def sketch(items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct hashes of the items' size-partitioned bottom-k sketches."""
    hashed = _hashed(items, "text", size).select(F.sort_array(F.array_distinct(F.coalesce("g", F.array().cast("array<bigint>")))).alias("g"))
    n = F.size("g")
    largest = F.pow(F.lit(2), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))) + 1) - 1
    k = F.least(n, (largest - F.ceil(largest * threshold - F.lit(1e-9)) + 1).cast("int"))
    return hashed.select(F.explode_outer(F.slice("g", 1, k)).alias("hash")).where(F.col("hash").isNotNull()).distinct()


def _matches(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    """(doc_id, copy, item_id, n_shingles, n_found, c): each row's containment of each item at ``threshold`` or more.

    The sketch and the candidates are written to the shared folder, so that the planner knows their sizes: it broadcasts
    them only below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
    """
    marks = materialize(sketch(items, size, threshold), "sketch")
    given = docs.select("doc_id", row_copy(F.col("text")).alias(COPY), "text")
    probed = _hashed(given, "text", size, "doc_id", COPY).select("doc_id", COPY, F.explode_outer("g").alias("hash"))
    hits = probed.join(marks, "hash", "left_semi").select("doc_id", COPY)
    candidates = materialize(hits.select(F.col("doc_id").alias("v_id"), F.col(COPY).alias("v_copy")).distinct(), "candidates")
    wanted = materialize(item_shingles(items, size), "item-shingles")
    again = given.join(candidates, same_row(given, candidates), "left_semi").select("doc_id", F.col(COPY).alias("copy"), words(F.lower("text")).alias("w"))
    found = again.select("doc_id", "copy", F.explode_outer(_shingles(F.col("w"), size)).alias("shingle")).join(wanted, "shingle")
    counted = found.groupBy("doc_id", "copy", "item_id", "variant", "n_shingles").agg(F.countDistinct("shingle").alias("n_found"))
    best = counted.groupBy("doc_id", "copy", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("c"), "n_shingles", "n_found")).alias("b"))
    return best.where(F.col("b.c") >= threshold).select("doc_id", "copy", "item_id", "b.n_shingles", "b.n_found", "b.c")


def contaminated(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs with at least ``threshold`` of an item's distinct shingles in a document.

    Returns (doc_id, item_id, n_shingles, n_found long, containment double), the best row of a repeated document id.
    """
    best = _matches(docs, items, size, threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("c", "n_shingles", "n_found")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shingles", "b.n_found", F.col("b.c").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose text contains no item, with all their columns; rows that share an id are judged by their own texts."""
    bad = materialize(_matches(docs, items, size, threshold).select(F.col("doc_id").alias("v_id"), F.col("copy").alias("v_copy")).distinct(), "contaminated")
    given = docs.withColumn(COPY, row_copy(F.col("text")))
    return given.join(bad, same_row(given, bad), "left_anti").select(*docs.columns)
