"""Repair of damaged text by the corpus's own vocabulary, and what damage is left (A11-A13, F13-F16, P10-P12, U6, J12, T-9).

Repairs are decided once per distinct token and then replaced in texts. A long token's possible parts are joined to the
vocabulary as rows, so no vocabulary is broadcast; only the last step, a dynamic programme over one token's known parts, is
Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.storage import perhaps_in, stored

# Fixed values
SHORT_WORDS = "a i an as at be by do go he if in is it me my no of on or so to up us we and the for you our its not all any can has had was were with".split()
RUN_ON, LONGEST, PIECE = 16, 20, 12
LIGATURES = [("ki", "fi"), ("kl", "fl")]
DAMAGED = 0.0025
#: Letters of a long token that one row holds.
SLICE = 256
PARTS = "array<struct<word:string,n:bigint,known:boolean,logp:double>>"
_SEAM = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[a-z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _tokens(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    return texts.select(*keep, F.explode_outer(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).where(F.col("token").isNotNull())


def token_counts(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """(token, times): the distinct tokens as they are written. Stored, it spares ``vocabulary`` and ``token_repairs`` a pass each."""
    return _tokens(texts, text).groupBy("token").agg(F.count(F.lit(1)).alias("times"))


def vocabulary(texts: DataFrame, dictionary: DataFrame | None = None, *, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(word, n, known, logp): A11, A12, P10, P11, U6. ``dictionary``: (word); its words get a floor below any count's weight.
    ``counts``: the texts' ``token_counts``, if at hand."""
    counts = (token_counts(texts, text=text) if counts is None else counts).where(F.length("token").between(2, 24)).groupBy(F.lower("token").alias("word")).agg(F.sum("times").alias("n"))
    total = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))  # one row
    spark = texts.sparkSession
    own = spark.createDataFrame([("a",), ("i",)], "word string").withColumn("known", F.lit(False))
    given = own if dictionary is None else own.unionByName(dictionary.select(F.lower("word").alias("word")).where(F.length("word") >= 2).distinct().withColumn("known", F.lit(True)))
    both = counts.withColumn("known", F.lit(False)).withColumn("floor", F.lit(False)).unionByName(given.withColumn("n", F.lit(0).cast("long")).withColumn("floor", F.lit(True)))
    merged = both.groupBy("word").agg(F.max("n").alias("n"), F.max("known").alias("known"), F.max("floor").alias("floor")).crossJoin(F.broadcast(total))
    scored = (F.col("n") > 0) & ((F.length("word") < RUN_ON) | F.col("known"))
    return merged.select("word", "n", "known", F.when(scored, F.log(F.col("n") / F.col("total"))).when(F.col("floor"), F.log(F.lit(0.1) / F.col("total"))).alias("logp"))


def segment(token: str, logp: dict[str, float]) -> list[str] | None:
    """the likeliest split into known words; the earliest cut wins ties; None without a full cover."""
    best: list[tuple[float, int] | None] = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        top: tuple[float, int] | None = None
        for start in range(max(0, end - LONGEST), end):
            word = token[start:end]
            if best[start] is None or word not in logp or (len(word) < 3 and word not in SHORT_WORDS):
                continue
            score = best[start][0] + logp[word]
            if top is None or score > top[0]:
                top = (score, start)
        best.append(top)
    if best[-1] is None:
        return None
    cuts, end = [], len(token)
    while end:
        start = best[end][1]
        cuts.append(token[start:end])
        end = start
    return cuts[::-1]


def accepted(parts: list[str] | None, n: dict[str, int]) -> bool:
    """F16: three parts or more, or two that the corpus has twice each."""
    return bool(parts) and (len(parts) > 2 or (len(parts) == 2 and all(n.get(p, 0) >= 2 for p in parts)))


def split_run_on(token: str, logp: dict[str, float], n: dict[str, int], known: set[str]) -> str | None:
    """the token with spaces, or None if it stays."""

    def plain(part: str) -> str | None:
        parts = segment(part.lower(), logp)
        if not accepted(parts, n):
            return None
        return " ".join(parts).capitalize() if part.istitle() else " ".join(parts)

    if token.islower() or token.istitle():
        return plain(token)
    pieces = _SEAM.split(token)
    if len(pieces) < 2:
        return None
    return " ".join((len(p) >= PIECE and (p.islower() or p.istitle()) and p.lower() not in known and plain(p)) or p for p in pieces)


def _suspect(token: Column) -> Column:
    """Whether a token may have a repair at all: it is long, or has letters that a ligature is read as."""
    low = F.lower(token)
    return (F.length(token) >= RUN_ON) | reduce(or_, [low.contains(a) for a, _ in LIGATURES])


def token_repairs(texts: DataFrame, vocab: DataFrame, *, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """(token, repaired, kind): what to write for a damaged token; kind is ligature or run_on. ``counts`` as in ``vocabulary``."""
    counts = token_counts(texts, text=text) if counts is None else counts
    distinct = counts.where(_suspect(F.col("token"))).select("token").withColumn("low", F.lower("token"))
    v = vocab.select("word", "n", "known")
    own = distinct.join(v.select(F.col("word").alias("low"), "n", "known"), "low", "left").select("token", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"))
    open_ = own.where(~F.col("known"))
    fixes = [F.struct(F.lit(i).alias("i"), F.replace("low", F.lit(a), F.lit(b)).alias("word"), F.col("low").contains(a).alias("has")) for i, (a, b) in enumerate(LIGATURES)]
    tried = open_.where(F.length("low") >= 4).select("token", F.col("n").alias("own"), F.explode(F.array(*fixes)).alias("f")).where("f.has").select("token", "own", "f.i", "f.word").join(v, "word")
    good = tried.where(F.col("known") | (F.col("n") > F.col("own"))).groupBy("token").agg(F.min_by("word", "i").alias("word"))
    cased = F.when(F.upper("token") == F.col("token"), F.upper("word")).when(F.col("token").rlike("^[A-Z]"), F.concat(F.upper(F.substring("word", 1, 1)), F.substring("word", 2, 100))).otherwise(F.col("word"))
    ligatures = good.select("token", cased.alias("repaired"), F.lit("ligature").alias("kind"))
    long = open_.where(F.length("token") >= RUN_ON).select("token", "low")
    found = known_parts(long, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for token, words in zip(batch.column("token").to_pylist(), batch.column("parts").to_pylist()):
                logp = {w["word"]: w["logp"] for w in words if w["logp"] is not None}
                out.append(split_run_on(token, logp, {w["word"]: w["n"] for w in words}, {w["word"] for w in words if w["known"]}))
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(out, pa.string())], ["token", "repaired"])

    runs = found.mapInArrow(run, "token string, repaired string").where("repaired IS NOT NULL")
    return ligatures.unionByName(runs.join(ligatures, "token", "left_anti").withColumn("kind", F.lit("run_on")))


def repair_texts(texts: DataFrame, repairs: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(key, text, repaired_tokens): each text with its own damaged tokens replaced. Only repairs that a text needs reach it."""
    found = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), _suspect)
    used = texts.select(key, F.explode(found).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("times")).join(repairs.select("token", "repaired"), "token")
    per = stored(used.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "repaired"))).alias("fix"), F.sum("times").alias("repaired_tokens")), "text-repairs")
    # texts that need no repair are not shuffled
    joined = perhaps_in(texts, per, key).join(per, key, "left")
    whole = perhaps_in(texts, per, key, inside=False).select(key, text, F.lit(0).cast("long").alias("repaired_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile("[A-Za-z]+")
        for batch in batches:
            out = []
            for t, fix in zip(batch.column(text).to_pylist(), batch.column("fix").to_pylist()):
                fix = dict(fix or [])
                out.append(t if t is None or not fix else word.sub(lambda m: fix.get(m[0], m[0]), t))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.string()), batch.column("repaired_tokens")], [key, text, "repaired_tokens"])

    kind = dict(texts.dtypes)[key]
    return whole.unionByName(joined.select(key, text, "fix", F.coalesce("repaired_tokens", F.lit(0)).cast("long").alias("repaired_tokens")).mapInArrow(run, f"{key} {kind}, {text} string, repaired_tokens long"))


def known_parts(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, parts) for (token, low): the vocabulary's words among a token's parts of at most ``LONGEST`` letters.

    A token is cut into slices first and its rows carry a hash of it, so a very long one is never copied per part."""
    named = tokens.withColumn("h", F.xxhash64("token"))
    slices = named.select("h", F.explode(F.transform(F.sequence(F.lit(1), F.length("low"), F.lit(SLICE)), lambda at: F.substring("low", at, F.lit(SLICE + LONGEST - 1)))).alias("part"))
    part, n = F.col("part"), F.length("part")
    inner = F.transform(F.sequence(F.lit(1), n), lambda at: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - at + 1)), lambda k: F.substring(part, at, k)))
    words = slices.select("h", F.explode(F.array_distinct(F.flatten(inner))).alias("word")).distinct()
    found = words.join(vocab, "word").groupBy("h").agg(F.collect_list(F.struct("word", "n", "known", "logp")).alias("parts"))
    return named.join(found, "h", "left").select("token", F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))


def residual_damage(texts: DataFrame, vocab: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(key, tokens, residual, ratio, damaged): the share of a text's tokens that are long, no word of the dictionary
    and without a split into known words. A text without tokens has the ratio 0. T-9 orders by falling ratio."""
    each = _tokens(texts, text, key)
    long = each.where(F.length("token") >= RUN_ON).select("token").distinct().withColumn("low", F.lower("token"))
    known = vocab.where("known").select(F.col("word").alias("low"))
    open_ = long.join(known, "low", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for token, words in zip(batch.column("token").to_pylist(), batch.column("parts").to_pylist()):
                whole.append(segment(token.lower(), {w["word"]: w["logp"] for w in words if w["logp"] is not None}) is None)
            yield batch.select(["token"]).filter(pa.array(whole, pa.bool_()))

    stuck = known_parts(open_, vocab).mapInArrow(run, "token string").withColumn("stuck", F.lit(1))
    counted = each.join(stuck, "token", "left").groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("tokens"), F.count("stuck").alias("residual"))
    rows = texts.select(key).distinct().join(counted, F.col(key).eqNullSafe(F.col("_key")), "left")
    ratio = F.when(F.col("tokens") > 0, F.col("residual") / F.col("tokens")).otherwise(F.lit(0.0))
    return rows.select(key, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("residual", F.lit(0)).alias("residual"), ratio.alias("ratio"), (ratio > DAMAGED).alias("damaged"))
