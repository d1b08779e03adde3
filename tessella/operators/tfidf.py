"""Sparse TF-IDF: counts, weights, cosine ranking (A1-A4, J5, J6, M1, M2, U1, E3, T-1).

The reference ranks one profile at a time and counts the profile among the documents of its inverse frequencies, so every
profile has its own corpus of N = postings + 1. Ranking all profiles at once keeps that: a term of the profile has a document
frequency one higher, which changes its weight in a closed form. Postings are therefore weighed once, and only the terms that
they share with a profile are corrected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import pairs, stems, words
from tessella.sources.storage import spread, stored


def term_counts(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """A1: (id, term, tf) for each distinct term of a row, counted inside the row (no shuffle): runs of the sorted terms.

    Words, terms and runs are columns of projections of their own, as an expression that is used twice is evaluated twice.
    """
    stemmed = docs.select(F.col(id_col), stems(words(text)).alias("w"))
    kept = stemmed.select(id_col, F.sort_array(F.coalesce(pairs(F.col("w")), F.array().cast("array<string>"))).alias("s"))
    s = F.col("s")
    cut = kept.select(id_col, "s", F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))).alias("at"))
    at = F.col("at")
    runs = F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - a).cast("long").alias("tf")))
    # explode_outer: from explode Spark would infer a filter that evaluates the arrays again below
    rows = cut.select(id_col, F.explode_outer(runs).alias("t")).where(F.col("t").isNotNull())
    return rows.select(id_col, "t.term", "t.tf")


def document_frequency(counts: DataFrame) -> DataFrame:
    """A2: (term, df) from one row per document and term."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    """A3: ln((1 + N) / (1 + df)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def tf_weight(tf: Column) -> Column:
    """M1: 1 + ln(tf)."""
    return F.log(tf.cast("double")) + 1


def cosine(dot: Column, a2: Column, b2: Column) -> Column:
    """M2: from squared norms; 0 where one is 0."""
    return F.when((a2 > 0) & (b2 > 0), dot / (F.sqrt(a2) * F.sqrt(b2))).otherwise(F.lit(0.0))


def rank_tfidf(profiles: DataFrame, postings: DataFrame, *, profile_id: str = "profile_id", posting_id: str = "posting_id", text: str = "text") -> DataFrame:
    """(profile_id, posting_id, similarity, score) for all pairs that share a term.

    Postings are read and counted once, into shared storage. A null or blank text has no terms and so no pair; rows that repeat
    an id count as one posting's text; with no postings or no profiles the ranking is empty. Similarities of other pairs are 0 (``with_unranked`` adds them). The profiles' terms are broadcast only if the planner
    finds them small; otherwise both sides are dealt out by term.
    """
    d = stored(term_counts(spread(postings.select(F.col(posting_id).alias("d_id"), text)), "d_id", text), "term-counts")
    p = term_counts(profiles.select(F.col(profile_id).alias("p_id"), text), "p_id", text).select("p_id", "term", tf_weight(F.col("tf")).alias("pw"))
    n = postings.agg((F.count(F.lit(1)) + 1).alias("n"))  # one row
    frequency = document_frequency(d).crossJoin(F.broadcast(n)).select("term", idf(F.col("n"), F.col("df")).alias("i0"), idf(F.col("n"), F.col("df") + 1).alias("i1"))
    d = d.join(frequency, "term").select("d_id", "term", tf_weight(F.col("tf")).alias("dw"), "i0", "i1")
    d_norm = d.groupBy("d_id").agg(F.sum(F.pow(F.col("dw") * F.col("i0"), 2)).alias("d2"))
    unseen = p.join(frequency, "term", "left").crossJoin(F.broadcast(n))
    p_norm = unseen.groupBy("p_id").agg(F.sum(F.pow(F.col("pw") * F.coalesce("i1", idf(F.col("n"), F.lit(1))), 2)).alias("p2"))
    shared = d.join(p, "term")
    met = shared.groupBy("p_id", "d_id").agg(
        F.sum(F.col("dw") * F.col("pw") * F.col("i1") * F.col("i1")).alias("dot"), F.sum(F.col("dw") * F.col("dw") * (F.col("i1") * F.col("i1") - F.col("i0") * F.col("i0"))).alias("more")
    )
    sim = cosine(F.col("dot"), F.col("d2") + F.col("more"), F.col("p2"))
    ranked = met.join(d_norm, "d_id").join(p_norm, "p_id")
    return ranked.select(F.col("p_id").alias(profile_id), F.col("d_id").alias(posting_id), sim.alias("similarity"), F.bround(sim * 100, 1).alias("score"))


def with_unranked(ranking: DataFrame, profiles: DataFrame, postings: DataFrame, *, profile_id: str = "profile_id", posting_id: str = "posting_id") -> DataFrame:
    """Postings that a profile's ranking lacks follow with score 0. One row per profile and posting: that is the
    result's size, so the profiles should be few."""
    every = profiles.select(profile_id).crossJoin(postings.select(posting_id))
    joined = every.join(ranking, [profile_id, posting_id], "left")
    return joined.select(profile_id, posting_id, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNull().alias("unranked"))
