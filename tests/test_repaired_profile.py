"""The registered profile query repairs its texts before lines are formed."""

import random

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import profile
from tessella.plans import registry


def test_profile_query_repairs_damaged_tokens(spark, tmp_path):
    rows = [(1, "We wrote the final report."), (2, "A final word. A final line."), (3, "We wrote the kinal report.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["text"]) for r in registry.QUERIES["e7_build_profile"](spark, str(tmp_path)).collect())
    assert got == [(1, "We wrote the final report."), (2, "A final word. A final line.")]


def test_a_line_is_worked_out_once():
    """Expressions that repeat their own parts grew to hundreds of passes a line, so that 0.1 GB did not end in time."""
    for made in (T.section_header("x"), T.redact_contacts("x"), profile.reflow(F.col("x"))):
        assert made._jc.toString().count("regexp_replace(") <= 30


def test_cheap_guards_change_no_line(spark):
    """Each guarded function against the plain patterns that it stands for."""
    rng = random.Random(3)
    parts = ["a", "Skills", "x@y.org", "555-123-4567", "٣٣٣ ٣٣٣ ٣٣٣٣", "github.com/a", "[email]", "page 2", "PAGE 3 of 4", "2024", " ", "  ", " ", " ", "\t", "\x1c", "\x1f", "\u0085", "​", "•", "-", ":", ".", "é", "語", "😀", "|", ",", "\r", "\r\n", "\n", " ", "W" * 50]
    rows = [None, "", *parts, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(3000))]
    x, bullets = F.col("x"), T.BULLETS.replace("-", r"\-")

    def bare(c):
        return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    def only(c):
        return F.length(F.regexp_replace(c, "[^A-Za-z]", "")) < 3

    tagged = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, T.EMAIL, "[email]"), T.PHONE, "[phone]"), T.PROFILE_URL, "[profile-url]")
    tidy = bare(F.regexp_replace(F.regexp_replace(tagged, r"(?U)\s+", " "), r"^[ |,•-]+|[ |,•-]+$", ""))
    parted = F.split(F.regexp_replace(x, T._LINE_ENDS, "\n"), "\n")
    pairs = [
        (T.strip("x"), bare(x)),
        (T.normalize_line("x"), bare(F.regexp_replace(F.regexp_replace(bare(F.translate(x, " ", " ")), rf"^[{bullets} ]+", ""), r"(?U)[\s\x1c-\x1f]+", " "))),
        (T.redact_contacts("x"), F.when(only(F.regexp_replace(tagged, r"\[(?:email|phone|profile-url)\]", "")), "").otherwise(tidy)),
        (T.is_noise("x"), (F.length(x) < 4) | only(x) | x.rlike(r"(?i)^page [0-9]+( of [0-9]+)?$")),
        (T.lines("x"), F.when(F.element_at(parted, -1) == "", F.slice(parted, 1, F.size(parted) - 1)).otherwise(parted)),
    ]
    frame = spark.createDataFrame([(r,) for r in rows], "x string")
    for k, (made, plain) in enumerate(pairs):
        got = frame.select("x", made.alias("made"), plain.alias("plain")).where(~F.col("made").eqNullSafe(F.col("plain"))).take(3)
        assert not got, (k, got)


def test_entries_beyond_a_part_and_their_sections(spark):
    text = "\n".join(["first.", *(line for k in range(400) for line in (f"Skills\nentry {k} of", "the rest."))])
    docs = spark.createDataFrame([("a", text)], "file_name string, text string")
    want = profile.sectioned(profile.logical_lines(docs)).select("line_no", "section", F.col("line").alias("text"))
    got = profile.profile_lines(docs).select("line_no", "section", "text")
    assert got.count() == 401 and got.exceptAll(want).count() == 0
