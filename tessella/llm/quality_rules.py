"""Quality rules: learned decision lists over text statistics (operator 1, native).

``text_stats`` measures whole texts with built-in expressions only. ``learn_rules`` grows and prunes conjunctions of
thresholds by sequential covering; every count that it looks at is a Spark aggregate over all labelled rows, and only
those counts (features x bins x 2) reach the driver. ``RuleList.verdict`` is an ordered CASE expression.

Defined results: a null or blank text has 0 words; rows with null or repeated ids are each measured; labels that are
null or repeated for a document count by their lowest value; without labels the list is empty and only the base rule
rejects. Very long texts are measured whole, in one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WHITE, materialize, words

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits"]


def _features() -> dict[str, Column]:
    """What rules may test, from the columns of ``text_stats``; shares are 0 where the whole is 0."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, row: bool = False) -> DataFrame:
    """One row per document: ``doc_id`` and the counts named in ``COUNTS`` (long), over the whole text. With ``row`` the
    document's own columns come along in one struct of that name, so none of them can clash.

    Windows are first compared by 64-bit hashes, where distinct hashes prove distinct windows; only texts in which a
    hash repeats are compared by their words.
    """

    def left(pattern: str) -> Column:
        """Characters that remain when all that matches is deleted."""
        return F.length(F.regexp_replace(F.col("t"), pattern, ""))

    own = ["doc_id", "_row"] if row else ["doc_id"]
    rows = [F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if row else []
    filled = docs.select(F.col(id_col).alias("doc_id"), *rows, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = filled.select(
        *own,
        words(F.col("t")).alias("w"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        left(r"[^A-Z]+").alias("n_upper"),
        left(r"[^!?]+").alias("n_marks"),
        left(r"[^0-9]+").alias("n_digits"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x, F.lit(WHITE))) > 0).alias("lines"),
    )
    hashed = split.select("*", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.array_distinct("lines").alias("once"))
    h = F.col("h")
    windows = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))
    seen = hashed.select(*own, "w", "n", "n_symbols", "n_upper", "n_marks", "n_digits", "lines", "once", windows.alias("win"))
    flagged = seen.withColumn("repeats", F.size(F.array_distinct("win")) < F.size("win")).drop("win")
    w, n = F.col("w"), F.col("n")
    keyed = flagged.withColumn(
        "sorted",
        F.when(F.col("repeats"), F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.concat_ws(" ", *[w[i + k] for k in range(WINDOW)]).alias("k"), i.alias("i"))))),
    )
    s = F.col("sorted")
    at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j - 1)["k"] == s[j]["k"]) | (F.get(s, j + 1)["k"] == s[j]["k"]))
    starts = keyed.withColumn("at", F.when(F.col("repeats"), F.sort_array(F.transform(at, lambda j: s[j]["i"])))).drop("sorted")
    p = F.col("at")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, j: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - p[j], F.lit(WINDOW))))
    return starts.select(
        *own,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size("once")).cast("long").alias("n_dup_lines"),
        F.when(F.size(p) > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_upper").cast("long"),
        F.col("n_marks").cast("long"),
        F.col("n_digits").cast("long"),
        # not a function of the row, so that no filter is pushed below, where it would evaluate all of this several times
        *([F.monotonically_increasing_id().alias("_at")] if row else []),
    )


def base_failed() -> Column:
    """Too few words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Literal:
    """feature > threshold (``above``) or feature <= threshold."""

    feature: str
    threshold: float
    above: bool

    def column(self) -> Column:
        x = _features()[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class RuleList:
    """Ordered rules; the first whose literals all hold rejects, and a document that none rejects is kept."""

    rules: list[list[Literal]] = field(default_factory=list)

    def verdict(self) -> Column:
        """1-based number of the rule that rejects, 0 if none: an ordered CASE expression."""
        out = F.lit(0)
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            hold = F.lit(True)
            for literal in rule:
                hold = hold & literal.column()
            out = F.when(hold, F.lit(number)).otherwise(out)
        return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", bins: int = 12, max_rules: int = 8, max_literals: int = 4, min_precision: float = 0.95, min_cover: int = 5) -> RuleList:
    """Sequential covering of the rejected class (label 0) over all labelled rows.

    Thresholds are quantiles of each class. Two of three rows (by a hash of the id) grow a rule by FOIL gain, the third
    prunes it to the prefix with the best (p - n) / (p + n). A rule is taken if its Laplace precision over all rows left
    is ``min_precision`` or more and it covers ``min_cover`` rows; its rows then leave and the next rule is grown.
    Ties go to the earlier feature and lower threshold, so the list is a function of the data alone.
    """
    feats = _features()
    names = list(feats)
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).alias("y"))
    rows = stats.where(~base_failed()).join(label, F.col("doc_id") == F.col("l_id")).select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), (F.col("y") == 0).alias("bad"), *[c.alias(k) for k, c in feats.items()])
    rows = materialize(rows, "rules-rows")
    cuts_at = [i / bins for i in range(1, bins)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(k, cuts_at, 1000).alias(k) for k in names]).collect()
    if len(quantiles) < 2:
        return RuleList()
    cuts = {k: sorted({float(x) for q in quantiles for x in q[k]}) for k in names}
    binned = rows.select("prune", "bad", F.array(*[sum((F.when(F.col(k) > t, 1).otherwise(0) for t in cuts[k]), F.lit(0)) for k in names]).alias("b"))
    # equal rows collapse to one with a count, so later passes read bins only
    left = materialize(binned.groupBy("prune", "bad", "b").agg(F.count(F.lit(1)).alias("c")), "rules-bins")

    def column(lits: list[tuple[int, int, bool]]) -> Column:
        out = F.lit(True)
        for f, cut, above in lits:
            out = out & ((F.col("b")[f] > cut) if above else (F.col("b")[f] <= cut))
        return out

    found: list[list[tuple[int, int, bool]]] = []
    while len(found) < max_rules:
        for rule in found[-1:]:
            left = left.where(~column(rule))
        rule, p0, n0 = [], None, None
        while len(rule) < max_literals:
            counted = left.where(~F.col("prune") & column(rule)).select("bad", "c", F.posexplode("b").alias("f", "v")).groupBy("f", "v", "bad").agg(F.sum("c").alias("c")).collect()
            by = [[[0, 0] for _ in range(len(cuts[k]) + 1)] for k in names]
            for r in counted:
                by[r["f"]][r["v"]][0 if r["bad"] else 1] += r["c"]
            p0, n0 = (sum(v[i] for v in by[0]) for i in (0, 1))
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, values in enumerate(by):
                p = n = 0
                for cut, (dp, dn) in enumerate(values[:-1]):
                    p, n = p + dp, n + dn
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if (g := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                            best = (g, (f, cut, above))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        prefix = [column(rule[: i + 1]) for i in range(len(rule))]
        sums = left.groupBy("prune").agg(*[F.sum(F.when(c & (F.col("bad") == bad), F.col("c")).otherwise(0)).alias(f"s{i}_{int(bad)}") for i, c in enumerate(prefix) for bad in (True, False)]).collect()
        of = {r["prune"]: r for r in sums}

        def score(i: int) -> float:
            p, n = (of[True][f"s{i}_{k}"] for k in (1, 0)) if True in of else (0, 0)
            return (p - n) / (p + n) if p + n else -1.0

        cut = max(range(len(rule)), key=lambda i: (score(i), -i))
        p, n = (sum(r[f"s{cut}_{k}"] for r in of.values()) for k in (1, 0))
        if p < min_cover or (p + 1) / (p + n + 2) < min_precision:
            break
        found.append(rule[: cut + 1])
    # a cut number c of feature k stands for the value cuts[k][c]: bin > c means x > cuts[k][c]
    return RuleList([[Literal(names[f], cuts[names[f]][cut], above) for f, cut, above in rule] for rule in found])


def quality_rules(docs: DataFrame, labels: DataFrame, **learn: float) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (number of the rejecting rule, 0: none) and ``kept`` for every document.

    The statistics are written once to the shared folder, as both learning and the verdict read them.
    """
    stats = materialize(text_stats(docs), "stats")
    rules = learn_rules(stats, labels, **learn)
    judged = stats.select("*", base_failed().alias("base_failed"), rules.verdict().alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, **learn: float) -> DataFrame:
    """The documents that are kept, with all their columns.

    Each row is judged by its own text, whatever its id: rules are learned from the labelled rows' statistics, and then the
    verdict is an expression over each row's statistics, so nothing is joined and nothing but the filter touches the rows.
    """
    wanted = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id")).distinct()
    stats = materialize(text_stats(docs), "stats")
    rules = learn_rules(stats.join(wanted, stats["doc_id"] == wanted["l_id"], "left_semi"), labels, **learn)
    judged = text_stats(docs, row=True)
    return judged.where(~base_failed() & (rules.verdict() == 0) & (F.col("_at") >= 0)).select("_row.*")
