"""Chunks and their incremental index.

A store is a folder of versions, each a Parquet snapshot, and a pointer table that names the current one. A sync plans the
difference by a full outer join of keys, keeps the rows of unchanged postings, adds those of new ones, writes a version and
then the pointer, so a reader sees one or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.storage import stored

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_text(text: str, size: int = 400, overlap: int = 80, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps and joined again with an overlap of whole
    pieces up to ``overlap`` characters. Nothing but outer white space is lost."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")

    def atoms(part: str, seps: list[str]) -> Iterator[str]:
        if len(part) <= size:
            yield part
            return
        sep = next((s for s in seps if s and s in part), "")
        if not sep:
            step = size - overlap
            for k in range(0, len(part), step):
                yield part[k : k + step]
            return
        rest = seps[seps.index(sep) + 1 :]
        pieces = part.split(sep)
        for i, x in enumerate(pieces):
            whole = x + (sep if i + 1 < len(pieces) else "")
            if whole:
                yield from atoms(whole, rest)

    out: list[str] = []
    held: list[str] = []
    length = 0
    for atom in atoms(text, separators or SEPARATORS):
        if held and length + len(atom) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(atom) > size):
                length -= len(held.pop(0))
        held.append(atom)
        length += len(atom)
    if held:
        out.append("".join(held))
    return [x.strip() for x in out if x.strip()]


def split_chunks(postings: DataFrame, *, size: int = 400, overlap: int = 80, text: str = "text") -> DataFrame:
    """postings exploded to (their columns but the text, chunk_index, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [split_text(t or "", size, overlap) for t in batch.column(text).to_pylist()]
            row = pa.array([i for i, p in enumerate(pieces) for _ in p], pa.int64())
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(row) for n in names), pa.array([k for p in pieces for k in range(len(p))], pa.int32()), pa.array([x for p in pieces for x in p], pa.string())], [*names, "chunk_index", "chunk"])

    kept = postings.drop(text)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return postings.select(*kept.columns, text).mapInArrow(run, ", ".join([*fields, "chunk_index int", "chunk string"]))


def index_key(content_hash: Column, size: int, overlap: int, model: str) -> Column:
    """E5: all that would change a posting's vectors."""
    return F.substring(F.sha2(F.concat_ws("|", content_hash, F.lit(str(size)), F.lit(str(overlap)), F.lit(model)), 256), 1, 16)


def plan_sync(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """(slug, action): added, updated, unchanged or removed, from (slug, index_key) of both sides. A stored key that is
    missing reads as empty and so is stale."""
    w = wanted.select(F.col("slug").alias("w_slug"), F.col("index_key").alias("w_key"))
    s = kept.groupBy(F.col("slug").alias("s_slug")).agg(F.coalesce(F.max("index_key"), F.lit("")).alias("s_key"))
    action = F.when(F.col("s_slug").isNull(), "added").when(F.col("w_slug").isNull(), "removed").when(F.col("w_key") == F.col("s_key"), "unchanged").otherwise("updated")
    return w.join(s, F.col("w_slug") == F.col("s_slug"), "full_outer").select(F.coalesce("w_slug", "s_slug").alias("slug"), action.alias("action"))


class IndexStore:
    """Versions of a chunk index below a folder that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> DataFrame | None:
        """The newest version, or None before the first."""
        try:
            last = self.spark.read.json(f"{self.path}/pointer").orderBy(F.desc("number")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return self.spark.read.parquet(f"{self.path}/{last['version']}")

    def _number(self) -> int:
        try:
            return int(self.spark.read.json(f"{self.path}/pointer").agg(F.max("number")).first()[0]) + 1
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise

    def write(self, chunks: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        chunks.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(self._number(), version)], "number long, version string").write.mode("append").json(f"{self.path}/pointer")

    def sync(self, postings: DataFrame, *, size: int = 400, overlap: int = 80, model: str = "none", rebuild: bool = False) -> DataFrame:
        """E5, K3-K5: bring the store up to date with postings (slug, text, content_hash and others); returns (slug, action)."""
        keyed = postings.withColumn("index_key", index_key(F.col("content_hash"), size, overlap, model))
        before = None if rebuild else self.current()
        empty = self.spark.createDataFrame([], "slug string, index_key string")
        plan = plan_sync(keyed, empty if before is None else before)
        rows = stored(plan, "sync-plan")  # versions that the plan reads stay, so it may be read again
        stale = rows.where(F.col("action").isin("added", "updated")).select("slug")
        new = split_chunks(keyed.join(stale, "slug", "left_semi"), size=size, overlap=overlap)
        if before is not None:
            same = rows.where(F.col("action") == "unchanged").select("slug")
            new = new.unionByName(before.join(same, "slug", "left_semi").select(*new.columns))
        self.write(new)
        return rows
