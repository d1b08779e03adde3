"""Command line over the engine (C1, K7-K9): build-profile, index-postings, rank, match and models.

JSON (or, with ``--text``, a report) goes to standard output; warnings and errors go to standard error. ``match`` explains
the best postings of a folder, or job files that are named (``--job``, ``-`` for standard input), which bypasses ranking. With
``--dry-run`` it shows the requests' sizes and costs; with ``--replies`` it reads a reviewer's replies (JSON lines with job_id,
stop_reason, text and token counts) instead of calling one, prices them and adds them to ``--ledger``.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cost, judge
from tessella.operators.review import markdown
from tessella.plans import report
from tessella.plans.engine import Engine
from tessella.sources.files import SourceError, append_ledger, extract_documents, read_jobs, read_postings, read_profile


def _print(df: DataFrame, single: bool = False) -> None:
    """K7, K8: a list, or one object."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()]
    print(json.dumps(rows[0] if single and len(rows) == 1 else rows, ensure_ascii=False, indent=1))


def _prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="model string, input_rate double, output_rate double")


def _show(df: DataFrame, a: argparse.Namespace) -> None:
    if a.text:
        for r in df.collect():
            print(report.match_page(r.asDict(recursive=True), color=sys.stdout.isatty()))
    else:
        _print(df, single=True)


def _matches(spark: SparkSession, engine: Engine, a: argparse.Namespace, chunks: DataFrame, whole: DataFrame, jobs: DataFrame) -> None:
    """The three ways of ``match``: explained locally, a dry run of the requests, or a reviewer's replies."""
    rates = _prices(spark, a.prices) if a.prices else spark.createDataFrame([], "model string, input_rate double, output_rate double")
    if a.dry_run:
        _print(judge.dry_run(whole.select(F.col("text").alias("profile")), jobs, rates, model=a.model).orderBy("job_id"))
        return
    if not a.replies:
        _show(engine.explain(chunks, jobs).orderBy(F.desc("score"), "job_id"), a)
        return
    counters = ", ".join(f"{c} long" for c in cost.COUNTERS)
    replies = spark.read.json(a.replies, schema=f"job_id string, model string, stop_reason string, text string, {counters}").fillna(a.model, ["model"])
    priced = cost.price(replies, rates)
    if warning := report.unpriced_warning(r["model"] for r in priced.where(~F.col("priced")).select("model").distinct().collect()):
        print(f"warning: {warning}", file=sys.stderr)
    if a.ledger:
        append_ledger(priced.select("job_id", "model", *cost.COUNTERS, "cost_usd"), a.ledger)
    known = jobs.select("job_id")
    got = judge.parse_replies(priced.join(known, "job_id", "left_semi"))
    for r in got.where("outcome != 'ok'").orderBy("job_id").collect():
        print(f"{r['job_id']}: {r['outcome']}: {r['error']}", file=sys.stderr)
    _show(got.where("outcome = 'ok'").select("job_id", "model", "score", "verdict", "strengths", "gaps", "rationale", "notes", "cost_usd").orderBy(F.desc("score"), "job_id"), a)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build-profile", help="one profile of a folder of documents")
    build.add_argument("folder")
    build.add_argument("out")
    build.add_argument("--keep-contact", action="store_true")
    build.add_argument("--review", help="folder for the review page")
    sync = sub.add_parser("index-postings", help="bring the chunk index up to date")
    sync.add_argument("folder")
    sync.add_argument("store")
    sync.add_argument("--rebuild", action="store_true")
    rank = sub.add_parser("rank", help="rank a folder of postings for a profile")
    match = sub.add_parser("match", help="explain the best postings for a profile")
    for x in (rank, match):
        x.add_argument("profile")
        x.add_argument("folder", nargs="?")
        x.add_argument("--top-k", type=int, default=5)
        x.add_argument("--text", action="store_true", help="a report instead of JSON")
    match.add_argument("--job", action="append", default=[], help="a job file, or - for standard input; may be repeated")
    match.add_argument("--dry-run", action="store_true")
    match.add_argument("--replies", help="JSON lines of a reviewer's replies")
    match.add_argument("--model", default="none")
    match.add_argument("--prices")
    match.add_argument("--ledger")
    models = sub.add_parser("models", help="list a price table (CSV: model, input_rate, output_rate)")
    models.add_argument("prices")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    engine = Engine(spark, getattr(a, "store", None))
    try:
        if a.command == "build-profile":
            docs = extract_documents(spark, a.folder)
            made = engine.profile_with_review(docs, path=a.out, keep_contact=a.keep_contact)
            for r in made.review.failures.collect():
                print(f"not read: {r['file_name']}: {r['error']}", file=sys.stderr)
            if a.review:
                page = markdown(made.review, made.content_hash)
                spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(a.review)
            print(json.dumps({"content_hash": made.content_hash, "unchanged": made.unchanged, **made.review.counts.first().asDict()}))
        elif a.command == "index-postings":
            _print(engine.sync(read_postings(spark, a.folder), rebuild=a.rebuild).groupBy("action").count())
        elif a.command == "models":
            _print(_prices(spark, a.prices).orderBy("input_rate", "output_rate"))
        else:
            chunks = read_profile(spark, a.profile)
            whole = chunks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text")).select(F.lit(0).alias("profile_id"), "text")
            if a.command == "match" and a.job:
                if a.folder:
                    print("warning: named jobs are not ranked; the folder and --top-k are not used", file=sys.stderr)
                jobs = read_jobs(spark, a.job)
            else:
                if not a.folder:
                    raise ValueError("a folder of postings or --job is needed")
                postings = read_postings(spark, a.folder)
                ranking = engine.rank(whole, postings)
                if a.command == "rank":
                    named = ranking.join(postings.select("slug", "title", "company", "label"), "slug").orderBy("rank")
                    if a.text:
                        print(report.ranking_table([r.asDict() for r in named.collect()], a.top_k, color=sys.stdout.isatty()))
                    else:
                        _print(named.select("rank", "slug", "title", "company", "score").orderBy("rank"))
                    return 0
                jobs = engine.select(ranking, postings, a.top_k).select(F.col("slug").alias("job_id"), "text")
            _matches(spark, engine, a, chunks, whole, jobs)
    except (SourceError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
