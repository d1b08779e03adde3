"""Text functions as column expressions. IDs are those of the survey's operator inventory.

All are null-safe in the way of built-ins: a null text gives a null (or an empty array where said).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------
#: Words that never count as terms: common English words, then those of any job advertisement.
STOP_WORDS = """a about above after again against all am an and any are aren as at be because been before being below
between both but by can cannot could couldn did didn do does doesn doing don down during each few for from further had
hadn has hasn have haven having he her here hers herself him himself his how i if in into is isn it its itself just let
ll me more most mustn my myself no nor not of off on once only or other ought our ours ourselves out over own re same
shan she should shouldn so some such than that the their theirs them themselves then there these they this those through
to too under until up ve very was wasn we were weren what when where which while who whom why will with won would wouldn
you your yours yourself yourselves ability able across also applicant apply candidate candidates company description ensure etc
experience including job must new please position preferred qualifications related required requirements role strong
team well work working years summary overview responsibilities responsibility duties seeking join opportunity benefits
salary applicants employer posting hire hiring day days week weeks month months full part time based include""".split()
#: Words left out of the token sets that near-duplicate lines are compared by.
NEAR_WORDS = """a an and are as at be by for from has have in into is it its of on or that the to with using used via
than then them they this was were will which who will your you our we i""".split()
#: Derivational endings and what they become, in the order of trial.
SUFFIXES = [("ational", "at"), ("ization", "iz"), ("isation", "iz"), ("ation", "at"), ("ement", ""), ("ment", ""), ("ness", ""), ("ing", ""), ("ed", "")]
#: Endings of the near-duplicate stemmer, in the order of trial.
NEAR_SUFFIXES = ["ing", "ed", "es", "s"]
#: A header's keyword and its section; the first keyword in this order decides.
SECTIONS = [
    ("summary", "SUMMARY"), ("objective", "SUMMARY"), ("profile", "SUMMARY"), ("about", "SUMMARY"),
    ("education", "EDUCATION"), ("academic", "EDUCATION"),
    ("experience", "EXPERIENCE"), ("employment", "EXPERIENCE"), ("work history", "EXPERIENCE"), ("internship", "EXPERIENCE"), ("professional", "EXPERIENCE"),
    ("project", "PROJECTS"), ("portfolio", "PROJECTS"),
    ("skill", "SKILLS"), ("technical", "SKILLS"), ("technolog", "SKILLS"), ("competenc", "SKILLS"), ("tools", "SKILLS"), ("languages", "SKILLS"),
    ("publication", "PUBLICATIONS"), ("research", "PUBLICATIONS"), ("paper", "PUBLICATIONS"),
    ("certification", "CERTIFICATIONS"), ("certificate", "CERTIFICATIONS"), ("licens", "CERTIFICATIONS"),
    ("award", "AWARDS"), ("honor", "AWARDS"), ("achievement", "AWARDS"), ("scholarship", "AWARDS"),
    ("leadership", "LEADERSHIP"), ("activit", "LEADERSHIP"), ("volunteer", "LEADERSHIP"), ("extracurricular", "LEADERSHIP"), ("involvement", "LEADERSHIP"), ("organization", "LEADERSHIP"),
    ("coursework", "COURSEWORK"), ("courses", "COURSEWORK"), ("relevant course", "COURSEWORK"),
]
#: Sections in the order of a rendered profile.
SECTION_ORDER = ["SUMMARY", "EDUCATION", "EXPERIENCE", "PROJECTS", "SKILLS", "PUBLICATIONS", "CERTIFICATIONS", "AWARDS", "LEADERSHIP", "COURSEWORK", "OTHER"]
#: What may start a list entry.
BULLETS = "•‣▪●·⁃-*−–—>"
WORD = r"[a-z][a-z0-9+#.]*"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"
PHONE = r"(?U)(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
PROFILE_URL = r"(?iU)\b(?:linkedin\.com|github\.com)/[\w./-]+"
# --------------------------------------------------------------------------------------------------------------------

_THREE_LETTERS = "[A-Za-z][^A-Za-z]*[A-Za-z][^A-Za-z]*[A-Za-z]"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``x``, which is worked out once however often ``fn`` names it, in lambdas too."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


#: White space of Unicode besides the plain space (what (?U)\\s has), spelled out, as properties are slow to test.
_ODD = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ends(x: Column) -> Column:
    """The first and the last character: a cheap test of whether anything at the ends is to be removed."""
    return F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))


def _spaced(x: Column) -> Column:
    """Whether a text has other white space than single plain spaces. A class of few ranges, which holds no odd white space, settles most texts."""
    return x.contains("  ") | x.rlike(r"[^ -~\xa1-\u167f]") & x.rlike(rf"[\x1c-\x1f{_ODD}]")


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return let(_c(text), lambda x: F.when(_ends(x).rlike(rf"[ \x1c-\x1f{_ODD}]"), F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(x))


def lines(text: Column | str) -> Column:
    """Lines at all of Unicode's line ends; no empty item after a final end."""
    cut = F.when(_c(text).contains("\r"), F.split(_c(text), _LINE_ENDS)).otherwise(F.split(_c(text), _LINE_ENDS.removeprefix(r"\r\n|")))
    return let(cut, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(text: Column | str) -> Column:
    """Lower-case words without outer dots, two characters or more, none of the common ones."""
    found = F.transform(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0)), lambda w: F.trim(w, F.lit(".")))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def _cut(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - n)


def stems(array: Column) -> Column:
    """F2 for an array of words: one plural rule, then the first derivational ending that leaves three letters, then a final e.

    Each step is a pass of its own over the array, so that no word is evaluated more than once a step.
    """

    def plural(w: Column) -> Column:
        long = F.length(w) > 4
        return (
            F.when(long & w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
            .when(long & w.endswith("sses"), _cut(w, 2))
            .when(long & w.endswith("es") & ~w.endswith("oes") & ~w.endswith("aes"), _cut(w, 2))
            .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), _cut(w, 1))
            .otherwise(w)
        )

    def derived(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for ending, new in SUFFIXES:
            out = out.when(w.endswith(ending) & (F.length(w) >= len(ending) + 3), F.concat(_cut(w, len(ending)), F.lit(new)))
        return out.otherwise(w)

    def silent(w: Column) -> Column:
        return F.when(w.endswith("e") & (F.length(w) > 4), _cut(w, 1)).otherwise(w)

    return F.transform(F.transform(F.transform(array, plural), derived), silent)


def stem(word: Column | str) -> Column:
    """F2 for one word."""
    return F.get(stems(F.array(_c(word))), F.lit(0))


def terms(text: Column | str) -> Column:
    """Stemmed words, then pairs of neighbours (formed after common words are gone, across line ends)."""
    return pairs(stems(words(text)))


def pairs(w: Column) -> Column:
    """Words and then their neighbouring pairs."""
    n = F.size(w)
    two = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.concat(w, two)).otherwise(w)


def near_tokens(text: Column | str) -> Column:
    """the distinct token set by which lines are compared."""
    found = F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(NEAR_WORDS))
    return F.array_distinct(F.transform(found, near_stem))


def near_stem(w: Column) -> Column:
    out = F.when(F.lit(False), w)
    for s in NEAR_SUFFIXES:
        out = out.when((F.length(w) - len(s) >= 4) & w.endswith(s), F.substring(w, F.lit(1), F.length(w) - len(s)))
    return out.otherwise(w)


def dedupe_key(text: Column | str) -> Column:
    """F7."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", " "))


def normalize_line(raw: Column | str) -> Column:
    """F8: no-break spaces as spaces, leading bullets gone, white space as one space."""
    bullets = BULLETS.replace("-", r"\-")

    def of(x: Column) -> Column:
        bare = F.regexp_replace(strip(F.translate(x, " ", " ")), rf"^[{bullets} ]+", "")
        spaced = strip(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "))
        # most lines have single plain spaces only
        return F.when(_spaced(x), spaced).otherwise(F.rtrim(F.ltrim(x, F.lit(BULLETS + " "))))

    return let(_c(raw), of)


def section_header(line: Column | str) -> Column:
    """the section that a line names if it looks like a header, else null."""

    def section(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for key, name in SECTIONS:
            out = out.when(low.contains(key), F.lit(name))
        return out

    def of(s: Column) -> Column:
        letters = F.regexp_replace(s, r"[^\p{L}]", "")
        capitals = F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
        titled = ~s.rlike(r"(?U)(?:^|\s)(?!\p{Lu})\p{L}")
        few = (F.length(s) > 0) & (F.length(s) <= 45) & (F.size(F.split(s, r"(?U)\s+")) <= 4)
        looks = few & (F.length(letters) > 0) & ((capitals / F.length(letters) >= 0.6) | titled) & ~s.endswith(".")
        return F.when(looks, let(F.lower(s), section))

    def bare(x: Column) -> Column:
        # a long line with nothing to remove at its ends is no header
        long = (F.length(x) > 45) & ~_ends(x).rlike(rf"[: \x1c-\x1f{_ODD}]")
        return F.when(~long, let(strip(F.regexp_replace(strip(x), r"^:+|:+$", "")), of))

    return let(_c(line), bare)


def redact_contacts(line: Column | str) -> Column:
    """E-mail, phone and profile address as tags; empty if fewer than three letters are left besides."""
    def tagged(x: Column, pattern: str, tag: str, needs: Callable[[Column], Column]) -> Column:
        return let(x, lambda y: F.when(needs(y), F.regexp_replace(y, pattern, tag)).otherwise(y))

    def tidied(x: Column) -> Column:
        rest = F.when(x.contains("["), F.regexp_replace(x, r"\[(?:email|phone|profile-url)\]", "")).otherwise(x)
        spaced = F.when(_spaced(x), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x)
        return F.when(rest.rlike(_THREE_LETTERS), strip(F.trim(spaced, F.lit(" |,•-")))).when(x.isNotNull(), "")

    # each pattern is put to the lines that have what it cannot do without
    out = tagged(_c(line), EMAIL, "[email]", lambda y: y.contains("@"))
    out = tagged(out, PHONE, "[phone]", lambda y: y.rlike(r"[^\x00-/:-\u065f]{3}") & y.rlike(r"(?U)\p{Nd}{3}[\s.-]?\p{Nd}{4}"))
    return let(tagged(out, PROFILE_URL, "[profile-url]", lambda y: y.contains("/")), tidied)


def is_noise(line: Column | str) -> Column:
    """P4."""
    x = _c(line)
    return (F.length(x) < 4) | ~x.rlike(_THREE_LETTERS) | F.substring(x, 1, 5).rlike("(?i)^page ") & x.rlike(r"(?i)^page [0-9]+( of [0-9]+)?$")


def elide(text: Column | str, most: int = 110) -> Column:
    """F17."""
    x = _c(text)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def drop_cids(text: Column | str) -> Column:
    """glyph references of broken PDF fonts as spaces."""
    return F.regexp_replace(_c(text), r"\(cid:[0-9]+\)", " ")


def content_hash(text: Column | str) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def header_fields(all_lines: Column | str, stem_name: Column | str) -> Column:
    """struct(title, company, location) from an array of ``lines``: the first eight count, a later one wins over an earlier one.
    The array should be a column, as it is used several times."""
    all_lines = _c(all_lines)
    head = F.slice(all_lines, 1, 8)

    def field(*names: str) -> Column:
        def one(name: str) -> Column:
            kept = F.try_element_at(F.filter(head, lambda x: x.rlike(_rule(name))), F.lit(-1))
            return F.nullif(F.regexp_extract(kept, _rule(name), 1), F.lit(""))

        return F.coalesce(*[one(n) for n in names], F.lit(""))

    first = strip(F.try_element_at(F.filter(all_lines, lambda x: F.length(strip(x)) > 0), F.lit(1)))
    title = F.coalesce(F.nullif(field("title", "role"), F.lit("")), first, F.initcap(F.translate(_c(stem_name), "_", " ")))
    return F.struct(title.alias("title"), field("company", "employer").alias("company"), field("location").alias("location"))


def _rule(name: str) -> str:
    return rf"(?i)^\s*{name}\s*:\s*(.+?)\s*$"


def label(title: Column | str, company: Column | str) -> Column:
    """Title - company, unless the company is empty or part of the title."""
    t, c = _c(title), F.coalesce(_c(company), F.lit(""))
    return F.when((c == "") | F.contains(t, c), t).otherwise(F.concat_ws(" - ", t, c))
