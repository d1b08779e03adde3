"""Review of a profile build (K1, K2, A19, T-8 to T-10): sources, failures, poor files and clusters as tables, and the counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import dedupe
from tessella.sources.storage import stored


@dataclass(frozen=True)
class Review:
    """``sources`` (file_name), ``failures`` (file_name, error), ``poor`` (file_name, ratio), ``clusters`` (cluster, place, section,
    size, file_name, line_no, text) and ``counts``, one row. Empty inputs give empty tables and zero counts."""

    sources: DataFrame
    failures: DataFrame
    poor: DataFrame
    clusters: DataFrame
    counts: DataFrame


def line_clusters(lines: DataFrame, *, key: str = "file_name", threshold: float = 0.72) -> DataFrame:
    """T-8: near-duplicate lines of a profile by cluster: (cluster, size, first_text, key, line_no, section, text). All pairs count.

    A line is named by a hash of its file and number; the cluster's first line is the one with the least file and number."""
    named = lines.withColumn("line_id", F.xxhash64(key, "line_no"))
    rooted = dedupe.whole_clusters(named, threshold=threshold)
    rows = stored(named.join(rooted, "line_id"), "clustered-lines")
    first = rows.groupBy("cluster_id").agg(F.min_by("text", F.struct(key, "line_no")).alias("first_text"))
    return rows.join(first, "cluster_id").select(F.col("cluster_id").alias("cluster"), F.col("cluster_size").alias("size"), "first_text", key, "line_no", "section", "text")


def review(extracted: DataFrame, raw_lines: DataFrame, kept: DataFrame, damage: DataFrame, repairs: DataFrame, *, key: str = "file_name") -> Review:
    """From a build's tables: ``extracted`` (key, text, error), the lines before and after exact de-duplication,
    ``residual_damage`` and the texts' ``repaired_tokens``."""
    read, failed = extracted.where("error IS NULL"), extracted.where("error IS NOT NULL")
    clusters = line_clusters(kept, key=key)
    one = lambda df, **cols: df.agg(*[c.alias(n) for n, c in cols.items()])
    rows = F.count(F.lit(1))
    parts = [one(read, files_read=rows), one(failed, files_failed=rows), one(raw_lines, raw_lines=rows), one(kept, kept_lines=rows), one(repairs, repaired_tokens=F.coalesce(F.sum("repaired_tokens"), F.lit(0))), one(clusters, clusters=F.count_distinct("cluster"))]
    counts = parts[0]
    for p in parts[1:]:  # one row each
        counts = counts.crossJoin(F.broadcast(p))
    counts = counts.withColumn("duplicates_removed", F.col("raw_lines") - F.col("kept_lines"))
    poor = damage.where("damaged").select(key, "ratio").orderBy(F.desc("ratio"), key)
    return Review(read.select(key).orderBy(key), failed.select(key, "error").orderBy(key), poor, clusters.orderBy(F.desc("size"), "first_text", "cluster", key, "line_no"), counts)


def markdown(r: Review, content_hash: str, *, key: str = "file_name") -> str:
    """K2: the review as a page. Its tables are lists for a reader, so they are few rows."""
    out = ["# Profile review", "", f"Content hash: `{content_hash}`", ""]

    def part(title: str, lines: list[str]) -> None:
        out.extend([f"## {title} ({len(lines)})", "", *(lines or ["_None._"]), ""])

    part("Sources read", [f"- {x[key]}" for x in r.sources.collect()])
    part("Files that could not be read", [f"- `{x[key]}`: {x['error']}" for x in r.failures.collect()])
    part("Files that read poorly", [f"- `{x[key]}`: {x['ratio']:.1%} of the words still run together" for x in r.poor.collect()])
    groups: dict[int, list] = {}
    for x in r.clusters.collect():
        groups.setdefault(x["cluster"], []).append(x)
    part("Near-duplicate entries, all of them kept", [f"- {g[0]['section']}, {len(g)} wordings\n" + "\n".join(f"  - {x['text']} (`{x[key]}`)" for x in g) for g in groups.values()])
    return "\n".join(out).rstrip() + "\n"
