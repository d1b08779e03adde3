"""Explained matches: weighted coverage, strengths, gaps, evidence (E1, E2, A10, J7-J9, J13, W12, T-4 to T-7, P16, F6).

All jobs are explained at once against one profile, given as chunks (profile_chunks: chunk_id, section, text). A job's corpus is
the chunks and the job itself, N = chunks + 1, and each of the job's terms has a document frequency one above the
chunks'. Ties in weight go to the term that stands first among the job's terms (words before pairs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import STOP_WORDS, elide, pairs, stems, words
from tessella.operators.dense import top_hits
from tessella.operators.tfidf import cosine, idf, term_counts, tf_weight
from tessella.sources.storage import spread, stored

KEY_TERMS = 30


def job_terms(jobs: DataFrame, job_id: str = "job_id", text: str = "text") -> DataFrame:
    """(job_id, term, surface, tf, first_pos): F6 gives the surface as first written."""
    spelled = jobs.select(F.col(job_id).alias("job_id"), words(text).alias("w"))
    both = spelled.select("job_id", stems(F.col("w")).alias("s"), "w").select("job_id", pairs(F.col("s")).alias("s"), pairs(F.col("w")).alias("w"))
    rows = both.select("job_id", F.posexplode_outer(F.arrays_zip("s", "w")).alias("pos", "x")).where(F.col("x").isNotNull())
    return rows.groupBy("job_id", F.col("x.s").alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"), F.min_by(F.col("x.w"), F.col("pos")).alias("surface"))


def verdict(coverage: Column) -> Column:
    """P16, on the unrounded coverage."""
    return F.when(coverage >= 0.60, "strong-overlap").when(coverage >= 0.35, "moderate-overlap").otherwise("weak-overlap")


def explain(chunks: DataFrame, jobs: DataFrame, *, job_id: str = "job_id", text: str = "text", top_terms: int = 10, top_chunks: int = 5, key_terms: int = KEY_TERMS) -> DataFrame:
    """One row per job with a term: coverage, score, verdict, similarity, strengths, gaps, best chunks, rationale.

    Chunks are read and counted once, into shared storage. A job without a term (null, blank, common words only) has no row;
    without chunks every coverage is 0; rows that repeat a job's id count as one text."""
    per_chunk = stored(term_counts(spread(chunks.select("chunk_id", "text")), "chunk_id"), "chunk-terms")
    n = chunks.agg((F.count(F.lit(1)) + 1).alias("n"))
    profile = stored(per_chunk.groupBy("term").agg(F.sum("tf").alias("ptf"), F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", tf_weight(F.col("ptf")).alias("pw"), idf(F.col("n"), F.col("df")).alias("i0"), idf(F.col("n"), F.col("df") + 1).alias("i1")), "profile-terms")
    jt = job_terms(jobs, job_id, text).crossJoin(F.broadcast(n)).join(profile, "term", "left")
    jt = jt.withColumn("weight", tf_weight(F.col("tf")) * F.coalesce("i1", idf(F.col("n"), F.lit(1)))).withColumn("has", F.col("pw").isNotNull())
    jt = stored(jt.withColumn("overlap", F.col("weight") * F.col("pw") * F.col("i1")), "job-terms")
    by_weight = Window.partitionBy("job_id").orderBy(F.desc("weight"), "first_pos")
    by_overlap = Window.partitionBy("job_id", "has").orderBy(F.desc("overlap"), F.desc("weight"), "first_pos")
    ranked = jt.withColumn("place", F.row_number().over(by_weight)).withColumn("side", F.row_number().over(by_overlap))
    key = F.col("place") <= key_terms
    summed = ranked.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(key, F.col("weight"))), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(key & F.col("has"), F.col("weight"))), F.lit(0.0)).alias("covered_weight"),
        F.count_if(key).alias("n_key"),
        F.count_if(key & F.col("has")).alias("n_covered"),
        F.sum(F.col("weight") * F.col("weight")).alias("j2"),
        F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("dot"),
        F.coalesce(F.sum(F.pow(F.col("pw"), 2) * (F.pow("i1", F.lit(2)) - F.pow("i0", F.lit(2)))), F.lit(0.0)).alias("more"),
    )
    p2 = profile.agg(F.sum(F.pow(F.col("pw") * F.col("i0"), 2)).alias("p2"))
    # gaps are read off the missing terms with the best places; only ``top_terms`` of each job are gathered
    missing = ranked.where(~F.col("has")).withColumn("m", F.row_number().over(Window.partitionBy("job_id").orderBy("place"))).where(F.col("m") <= top_terms)
    gaps = missing.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "surface"))), lambda x: F.struct(x["surface"].alias("requirement"), F.lit("unknown").alias("severity"))).alias("gaps"))
    scores = chunk_scores(per_chunk, profile, ranked)
    strengths = evidence(ranked.where(F.col("has") & (F.col("side") <= top_terms)), per_chunk, scores, chunks, top_terms)
    best = (
        scores.withColumn("b", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("chunk_score"), "chunk_id"))).where(F.col("b") <= top_chunks).join(chunks.select("chunk_id", "section"), "chunk_id")
        .groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("b", "chunk_id", "section", "chunk_score"))).alias("best_chunks"))
    )
    coverage = F.when(F.col("total") > 0, F.col("covered_weight") / F.col("total")).otherwise(F.lit(0.0))
    out = summed.crossJoin(F.broadcast(p2)).join(gaps, "job_id", "left").join(strengths, "job_id", "left").join(best, "job_id", "left")
    similarity = cosine(F.col("dot"), F.col("j2"), F.coalesce("p2", F.lit(0.0)) + F.col("more"))
    return out.select(
        F.col("job_id").alias(job_id), coverage.alias("coverage"), F.bround(coverage * 100, 1).alias("score"), verdict(coverage).alias("verdict"), similarity.alias("similarity"), "n_key", "n_covered", "strengths", "gaps", "best_chunks",
        F.format_string("%d of the %d most distinctive terms appear in the profile, %.0f%% by weight; cosine similarity %.3f", "n_covered", "n_key", coverage * 100, similarity).alias("rationale"),
    )


def chunk_scores(per_chunk: DataFrame, profile: DataFrame, job: DataFrame) -> DataFrame:
    """T-7: (job_id, chunk_id, chunk_score): cosine of each chunk that shares a term with the job. A chunk's weights use the
    job's corpus, so shared terms correct its norm as in ranking."""
    weighed = per_chunk.join(profile.select("term", "i0", "i1"), "term").select("chunk_id", "term", tf_weight(F.col("tf")).alias("cw"), "i0", "i1")
    norm = weighed.groupBy("chunk_id").agg(F.sum(F.pow(F.col("cw") * F.col("i0"), 2)).alias("c2"))
    j2 = job.groupBy("job_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("j2"))
    met = job.where("has").select("job_id", "term", "weight").join(weighed, "term").groupBy("job_id", "chunk_id").agg(
        F.sum(F.col("cw") * F.col("i1") * F.col("weight")).alias("dot"), F.sum(F.pow("cw", F.lit(2)) * (F.pow("i1", F.lit(2)) - F.pow("i0", F.lit(2)))).alias("more")
    )
    return met.join(norm, "chunk_id").join(j2, "job_id").select("job_id", "chunk_id", cosine(F.col("dot"), F.col("c2") + F.col("more"), F.col("j2")).alias("chunk_score"))


def evidence(top: DataFrame, per_chunk: DataFrame, scores: DataFrame, chunks: DataFrame, top_terms: int) -> DataFrame:
    """For each strength in order the best chunk with its term that no strength before it quotes, or the best one.

    At most ``top_terms`` - 1 chunks can be taken before, so as many best candidates of a term as there are strengths suffice.
    """
    found = top.select("job_id", "term", "surface", "side").join(per_chunk.select("term", "chunk_id"), "term").join(scores, ["job_id", "chunk_id"])
    order = Window.partitionBy("job_id", "term").orderBy(F.desc("chunk_score"), "chunk_id")
    few = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top_terms)
    per_term = few.groupBy("job_id", "side", "surface").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"]).alias("candidates"))
    per_job = per_term.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("side", "surface", "candidates"))).alias("wanted"))
    kind = dict(chunks.dtypes)["chunk_id"]
    start = F.array().cast(f"array<struct<requirement:string,chunk_id:{kind}>>")

    def pick(done: Column, x: Column) -> Column:
        unused = F.filter(x["candidates"], lambda c: ~F.exists(done, lambda d: d["chunk_id"] == c))
        return F.concat(done, F.array(F.struct(x["surface"].alias("requirement"), F.coalesce(F.get(unused, F.lit(0)), F.get(x["candidates"], F.lit(0))).cast(kind).alias("chunk_id"))))

    picked = per_job.select("job_id", F.posexplode(F.aggregate("wanted", start, pick)).alias("o", "s"))
    quoted = picked.select("job_id", "o", "s.requirement", "s.chunk_id").join(chunks.select("chunk_id", elide("text").alias("evidence")), "chunk_id")
    return quoted.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "requirement", "evidence", "chunk_id"))), lambda x: F.struct(x["requirement"].alias("requirement"), x["evidence"].alias("evidence"), x["chunk_id"].alias("chunk_id"))).alias("strengths"))


def similarity(chunks: DataFrame, jobs: DataFrame, *, backend: str = "stem", embed: Callable[[DataFrame], DataFrame] | None = None, job_id: str = "job_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((job_id, similarity) of the whole profile, (job_id, chunk_id, chunk_score)) by one of three back ends.

    ``stem``: stemmed terms, a corpus of the chunks and the job. ``raw``: unstemmed words of two characters or more, and the
    joined profile is one more text of the corpus. ``dense``: cosine of the vectors that ``embed`` adds as ``embedding`` to rows
    with ``chunk``; without ``embed`` it is an error. Pairs without a common term are left out by the first two."""
    if backend == "dense":
        if embed is None:
            raise ValueError("the dense back end needs a function that embeds texts")
        gather = lambda df, i: embed(df.select(F.col(i).alias("id"), F.col("text").alias("chunk"))).select("id", "embedding")
        j = gather(jobs.select(job_id, F.col(text).alias("text")), job_id).select(F.col("id").alias("query_id"), "embedding")
        c = gather(chunks, "chunk_id").withColumn("ordinal", F.xxhash64("id"))
        every = top_hits(j, c, k=max(1, chunks.count()))
        whole = chunks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text")).select(F.lit(0).alias("profile"), "text")
        p = gather(whole, "profile").withColumn("ordinal", F.lit(0).cast("long"))
        return top_hits(j, p, k=1).select(F.col("query_id").alias(job_id), "similarity"), every.select(F.col("query_id").alias(job_id), F.col("id").alias("chunk_id"), F.col("similarity").alias("chunk_score"))
    if backend not in ("stem", "raw"):
        raise ValueError(f"unknown back end {backend!r}; one of stem, raw, dense")
    raw = backend == "raw"
    count = (lambda df, i: raw_counts(df, i)) if raw else term_counts
    own = 1 if raw else 0  # the profile itself in the corpus
    per_chunk = stored(count(chunks.select("chunk_id", "text"), "chunk_id"), "chunk-terms")
    n = chunks.agg((F.count(F.lit(1)) + 1 + own).alias("n"))
    profile = per_chunk.groupBy("term").agg(F.sum("tf").alias("ptf"), (F.count(F.lit(1)) + own).alias("df")).crossJoin(F.broadcast(n)).select("term", tf_weight(F.col("ptf")).alias("pw"), idf(F.col("n"), F.col("df")).alias("i0"), idf(F.col("n"), F.col("df") + 1).alias("i1"))
    jt = count(jobs.select(F.col(job_id).alias("job_id"), F.col(text).alias("text")), "job_id").crossJoin(F.broadcast(n)).join(profile, "term", "left")
    jt = jt.select("job_id", "term", "pw", "i0", "i1", F.col("pw").isNotNull().alias("has"), (tf_weight(F.col("tf")) * F.coalesce("i1", idf(F.col("n"), F.lit(1)))).alias("weight"))
    p2 = profile.agg(F.sum(F.pow(F.col("pw") * F.col("i0"), 2)).alias("p2"))
    more = F.sum(F.pow("pw", F.lit(2)) * (F.pow("i1", F.lit(2)) - F.pow("i0", F.lit(2))))
    whole = jt.groupBy("job_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("j2"), F.sum(F.col("weight") * F.col("pw") * F.col("i1")).alias("dot"), more.alias("more")).crossJoin(F.broadcast(p2)).where("dot IS NOT NULL")
    return whole.select(F.col("job_id").alias(job_id), cosine(F.col("dot"), F.col("j2"), F.col("p2") + F.col("more")).alias("similarity")), chunk_scores(per_chunk, profile, jt).withColumnRenamed("job_id", job_id)


def raw_counts(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf) of unstemmed words of two characters or more that are no common words, and their neighbouring pairs."""
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    rows = docs.select(id_col, found.alias("w")).select(id_col, F.explode_outer(pairs(F.col("w"))).alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
