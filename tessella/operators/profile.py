"""From documents to one profile (E7, W1, W11, F8-F12, P4-P6, A17, A19, K1, K2): lines, sections, clean-up, rendering."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import BULLETS, SECTION_ORDER, content_hash, is_noise, let, lines, normalize_line, redact_contacts, section_header
from tessella.operators.dedupe import dedupe_exact

KNOWN = "array<struct<line:string,listed:boolean,head:string,small:boolean>>"
ENTRY = "struct<section:string,line:string,header:boolean>"
#: Entries that the fold copies at most for a new one.
PART = 256

# Fixed values -------------------------------------------------------------------------------------------------------
#: Words that no sentence ends in.
DANGLING = """a an and as at between by for from in into of on or over the through to under using with across within during
against about after before while that which who whose is are was were has have had been being will would can could per via
than then both either neither not but so yet""".split()
#: What ends an entry, and what shows that it goes on.
ENDS, GOES_ON = [".", "!", "?", ":", ";"], [",", "-", "–", "/", "&"]
# --------------------------------------------------------------------------------------------------------------------


def _any_end(text: Column, ends: list[str]) -> Column:
    return reduce(or_, [text.endswith(e) for e in ends])


def _joins(entry: Column, head: Column, x: Column) -> Column:
    """whether the line ``x`` is the wrapped rest of the entry so far, whose section is ``head`` if it is a header."""
    last_word = F.lower(F.regexp_extract(entry, r"(?U)(\S+?),*\s*$", 1))
    open_end = _any_end(entry, GOES_ON) | last_word.isin(DANGLING)
    barred = (entry == "") | (x["line"] == "") | x["listed"] | x["head"].isNotNull() | head.isNotNull() | (F.length(entry) > 600) | _any_end(entry, ENDS)
    return ~barred & (x["small"] | open_end)


def entries(text: Column, default: str = "SUMMARY") -> Column:
    """array<struct<section, line, header>> of a text's logical lines; a header belongs to its own section.
    Whether a line goes on depends on the entry so far, so the lines are folded one after another; what is known of a line by
    itself is worked out before. Entries are gathered in parts of ``PART``, so that no long array is copied for each line."""
    bullet = rf"(?U)^[\s\x1c-\x1f]*[{BULLETS.replace('-', chr(92) + '-')}]"
    first = lambda raw: F.substring(raw, 1, 1)
    known = F.transform(
        F.transform(
            lines(text),
            lambda raw: F.struct(normalize_line(raw).alias("line"), F.when(first(raw).rlike(r"(?U)[\s\x1c-\x1f]"), raw.rlike(bullet)).otherwise(first(raw).isin(list(BULLETS))).alias("listed"), F.regexp_extract(raw, r"\p{L}", 0).rlike(r"\p{Ll}").alias("small")),
        ),
        lambda x: F.struct(x["line"].alias("line"), x["listed"].alias("listed"), section_header(x["line"]).alias("head"), x["small"].alias("small")),
    )
    none = F.array().cast(f"array<{ENTRY}>")
    start = F.struct(F.array().cast(f"array<array<{ENTRY}>>").alias("done"), none.alias("part"), F.lit(default).alias("section"), F.lit("").alias("entry"), F.lit(None).cast("string").alias("head"))

    def grown(acc: Column) -> Column:
        own = F.struct(F.coalesce(acc["head"], acc["section"]).alias("section"), acc["entry"].alias("line"), acc["head"].isNotNull().alias("header"))
        return F.when(acc["entry"] == "", acc["part"]).otherwise(F.concat(acc["part"], F.array(own)))

    def step(acc: Column, x: Column) -> Column:
        entry = acc["entry"]
        seam = F.when(entry.rlike(r"\p{L}-$"), F.concat(F.substring(entry, F.lit(1), F.length(entry) - 1), x["line"])).otherwise(F.concat_ws(" ", entry, x["line"]))
        longer = let(seam, lambda e: F.struct(acc["done"].alias("done"), acc["part"].alias("part"), acc["section"].alias("section"), e.alias("entry"), section_header(e).alias("head")))
        full = F.size(acc["part"]) >= PART
        fresh = F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, grown(F.struct(none.alias("part"), acc["section"].alias("section"), entry.alias("entry"), acc["head"].alias("head")))).otherwise(grown(acc)).alias("part"),
            F.coalesce(acc["head"], acc["section"]).alias("section"),
            x["line"].alias("entry"),
            x["head"].alias("head"),
        )
        return F.when(_joins(entry, acc["head"], x), longer).otherwise(fresh)

    return F.aggregate(F.coalesce(known, F.array().cast(KNOWN)), start, step, lambda acc: F.concat(F.flatten(acc["done"]), grown(acc)))


def reflow(text: Column) -> Column:
    """The array of a text's logical lines."""
    return F.transform(entries(text), lambda e: e["line"])


def logical_lines(docs: DataFrame, *, key: str = "file_name", text: str = "text") -> DataFrame:
    """(key, line_no, line). A null or blank text has no lines."""
    return docs.select(F.col(key), F.posexplode_outer(reflow(F.col(text))).alias("line_no", "line")).where(F.col("line").isNotNull()).select(key, F.col("line_no").cast("long"), "line")


def sectioned(lines: DataFrame, *, key: str = "file_name", line: str = "line", default: str = "SUMMARY") -> DataFrame:
    """Lines with the section of the last header before them; header lines go."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("header", section_header(line)).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(w), F.lit(default)))
    return marked.where(F.col("header").isNull()).drop("header")


def profile_lines(docs: DataFrame, *, key: str = "file_name", text: str = "text", keep_contact: bool = False) -> DataFrame:
    """(key, line_no, section, text): reflow, sections, contacts, noise, in this order."""
    rows = docs.select(F.col(key), F.posexplode(entries(F.col(text))).alias("line_no", "e")).where(~F.col("e.header"))
    shown = F.col("e.line") if keep_contact else redact_contacts("e.line")
    # one expression for both tests, as a column that a filter names would be worked out again for each use
    kept = F.filter(F.array(shown), lambda x: (F.length(x) > 0) & ~is_noise(x))
    return rows.select(key, F.col("line_no").cast("long").alias("line_no"), F.col("e.section").alias("section"), F.explode(kept).alias("text"))


def build_profile(docs: DataFrame, *, key: str = "file_name", text: str = "text", keep_contact: bool = False) -> DataFrame:
    """(key, line_no, section, text): all documents' lines, the first of each section and key kept."""
    return dedupe_exact(profile_lines(docs, key=key, text=text, keep_contact=keep_contact), order=(key, "line_no"))


def render_profile(lines: DataFrame, *, key: str = "file_name") -> DataFrame:
    """One row (body, content_hash): sections in their fixed order. The profile is one text by definition."""
    rank = F.coalesce(*[F.when(F.col("section") == s, i) for i, s in enumerate(SECTION_ORDER)], F.lit(len(SECTION_ORDER)))
    part = lines.groupBy("section").agg(F.array_sort(F.collect_list(F.struct(key, "line_no", "text"))).alias("x")).select(rank.alias("rank"), "section", F.concat(F.lit("== "), "section", F.lit(" ==\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["text"])), "\n")).alias("part"))
    body = part.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section", "part"))), lambda r: r["part"]), "\n\n"), F.lit("\n")).alias("body"))
    return body.select("body", content_hash("body").alias("content_hash"))
