"""Facade over the operators (E6, E8, T26, C1-C3): rank, select, explain, build and sync with one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import coverage, dedupe, dense, index, profile, repair, review, tfidf
from tessella.sources.storage import discard, stored

BACKENDS = ("tfidf", "dense")


@dataclass(frozen=True)
class BuiltProfile:
    """A profile's lines, its rendered text and hash, whether the file at hand was the same, and the review."""

    lines: DataFrame
    body: str
    content_hash: str | None
    unchanged: bool
    review: review.Review


class Engine:
    """``store``: folder of the chunk index (dense backend). ``embed``: DataFrame -> DataFrame that adds ``embedding`` to rows
    with ``chunk``; without it the dense backend asks for tables that have vectors already."""

    def __init__(self, spark: SparkSession, store: str | None = None, embed=None, model: str = "none"):
        self.spark, self.store, self.embed, self.model = spark, store, embed, model

    def sync(self, postings: DataFrame, *, size: int = 400, overlap: int = 80, rebuild: bool = False, backend: str = "dense") -> DataFrame:
        """(slug, action). The tfidf backend keeps no index: everything is unchanged."""
        if backend == "tfidf":
            return postings.select("slug", F.lit("unchanged").alias("action"))
        if not self.store:
            raise ValueError("the dense backend needs a store folder")
        return index.IndexStore(self.spark, self.store).sync(postings, size=size, overlap=overlap, model=self.model, rebuild=rebuild)

    def rank(self, profiles: DataFrame, postings: DataFrame, *, backend: str = "tfidf", fanout: int = 25, auto_index: bool = True) -> DataFrame:
        """(profile_id, slug, similarity, score, unranked, rank) for tfidf; (slug, ..., score, unranked, rank) for dense, where
        ``profiles`` are the profile's chunks (query_id, chunk or embedding)."""
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}; one of {', '.join(BACKENDS)}")
        if backend == "tfidf":
            found = tfidf.rank_tfidf(profiles, postings, posting_id="slug")
            full = tfidf.with_unranked(found, profiles, postings, posting_id="slug")
            return self._placed(full, "profile_id")
        if auto_index:
            self.sync(postings)
        chunks = index.IndexStore(self.spark, self.store).current()
        vectors = lambda df: df if "embedding" in df.columns else self.embed(df)
        numbered = vectors(chunks).withColumn("ordinal", F.xxhash64("slug", "chunk_index"))
        ranking = dense.rank_dense(vectors(profiles), numbered.select("slug", "chunk_index", "ordinal", "embedding"), fanout=fanout)
        full = postings.select("slug").join(ranking, "slug", "left").withColumn("unranked", F.col("score").isNull()).fillna({"score": 0.0, "similarity": 0.0})
        return self._placed(full)

    @staticmethod
    def _placed(full: DataFrame, *keys: str) -> DataFrame:
        from pyspark.sql import Window

        return full.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("unranked", F.desc("score"), "slug")))

    def select(self, ranking: DataFrame, postings: DataFrame, top_k: int = 5) -> DataFrame:
        """E8, T-3, P9, J3: texts of the first ``top_k`` postings with a score above 0."""
        if top_k <= 0:
            raise ValueError("no posting selected: top_k must be positive")
        return ranking.where((F.col("rank") <= top_k) & (F.col("score") > 0)).join(postings.select("slug", "text"), "slug")

    def explain(self, chunks: DataFrame, jobs: DataFrame, **how: int) -> DataFrame:
        """E1 for all jobs at once."""
        return coverage.explain(chunks, jobs, **how)

    def build_profile(self, documents: DataFrame, *, dictionary: DataFrame | None = None, keep_contact: bool = False, key: str = "file_name") -> DataFrame:
        """Repaired, reflowed, sectioned, redacted and de-duplicated lines of documents (key, text)."""
        lines, _, repaired, vocab = self._built(documents, dictionary, keep_contact, key)
        discard(repaired, vocab)
        return lines

    def _built(self, documents: DataFrame, dictionary: DataFrame | None, keep_contact: bool, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """The profile's lines, those before de-duplication, the repaired texts and the vocabulary."""
        good = documents.where(F.col("text").isNotNull())
        counts = stored(repair.token_counts(good), "token-counts")
        vocab = stored(repair.vocabulary(good, dictionary, counts=counts), "vocabulary")  # T21: built once, from the raw texts
        repairs = stored(repair.token_repairs(good, vocab, counts=counts), "repairs")
        repaired = stored(repair.repair_texts(good, repairs, key=key), "repaired")
        discard(counts, repairs)
        raw = stored(profile.profile_lines(repaired, key=key, keep_contact=keep_contact), "profile-lines")
        return dedupe.dedupe_exact(raw, order=(key, "line_no")), raw, repaired, vocab

    def profile_with_review(self, documents: DataFrame, *, path: str | None = None, dictionary: DataFrame | None = None, keep_contact: bool = False, key: str = "file_name") -> BuiltProfile:
        """E7 in full: the profile with its near-duplicate clusters, poor files and counts (K1, K2, A19). ``documents`` has an
        ``error`` column, as ``extract_documents`` gives it. With ``path`` the rendered profile is written there, unless the
        same text is there already (``unchanged``)."""
        lines, raw, repaired, vocab = self._built(documents, dictionary, keep_contact, key)
        kept = stored(lines, "profile")
        found = review.review(documents, raw, kept, repair.residual_damage(repaired, vocab, key=key), repaired, key=key)
        made = profile.render_profile(kept, key=key).first()
        unchanged = False
        if path:
            try:
                before = self.spark.read.text(path, wholetext=True).first()
            except AnalysisException:
                before = None
            unchanged = before is not None and before[0].rstrip("\n") == (made["body"] or "").rstrip("\n")
            if not unchanged:
                self.spark.createDataFrame([(made["body"] or "",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return BuiltProfile(kept, made["body"] or "", made["content_hash"], unchanged, found)
