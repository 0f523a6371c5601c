"""Column builders on free text: predicates, parsers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimora.functions.words import NO_TEAM_WORDS, VAGUE_WORDS


def contains_any(c: Column, words) -> Column:
    """Whether the lower-cased text contains any of the words, be it within other words."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(f"\\Q{w}\\E" for w in words))


def one_of(c: Column, words) -> Column:
    return F.lower(c).isin(*words)


def stripped(c: Column) -> Column:
    """Without white space at both ends, in Unicode's sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def otherwise(c: Column, default: str) -> Column:
    """The text, or a default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def number_in(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def duration_days(c: Column) -> Column:
    """Working days of a timeline: years of 230, months of 21, weeks of 5; a bare number is months;
    130 where nothing says how long."""
    low = F.lower(F.coalesce(c, F.lit("")))
    first = number_in(low, r"(\d+)").try_cast("long")
    years = number_in(low, r"(\d+\.?\d*)\s*(?:year|yr)").try_cast("double")
    return (
        F.when(low == "", F.lit(130).cast("long"))
        .when(contains_any(c, ("year", "yr")), (F.coalesce(years, F.lit(1.0)) * 230).cast("long"))
        .when(low.contains("month"), F.coalesce(first, F.lit(6)) * 21)
        .when(low.contains("week"), F.coalesce(first, F.lit(4)) * 5)
        .otherwise(F.coalesce(first * 21, F.lit(130)))
    )


def team_size(c: Column) -> Column:
    """The sum of all numbers in a text; 1 if there are none, 0 if it says that nobody is there."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\d+)"), F.lit(1))
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.try_cast("long"), F.lit(0)))
    return F.when(contains_any(c, NO_TEAM_WORDS), F.lit(0).cast("long")).when(F.size(found) == 0, F.lit(1).cast("long")).otherwise(total)


def occurrences(c: Column, word: str) -> Column:
    """How often a word is in a text, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def answer_points(c: Column) -> Column:
    """4 points for a specific answer, 2 for a vague one, 0 for none."""
    return F.when(blank(c), 0).when(contains_any(c, VAGUE_WORDS), 2).otherwise(4)


def safe_name(c: Column) -> Column:
    """A text as a file name: letters, digits, _ - and . stay."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_\-.]", "_")


def without_front_matter(c: Column) -> Column:
    """A document without its leading block between two lines of dashes, if that block ends."""
    closing = F.locate("---", c, 4)
    body = F.regexp_replace(F.substring(c, closing + 3, F.length(c)), r"^\n+", "")
    return F.when(c.startswith("---") & (closing > 0), body).otherwise(c)


def shortened(c: Column, most: int) -> Column:
    """The first characters and three dots, if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def section(c: Column, name: str) -> Column:
    """What follows a section's name up to the next line that begins with a name, stripped."""
    return stripped(F.regexp_extract(c, rf"(?is){name}[:\s]*(.*?)(?=\n[A-Z_]{{3,}}[:\s]|\z)", 1))


def titled(c: Column) -> Column:
    """A type or methodology with capitals at the start of each part."""
    return F.when(c == "v-model", "V-Model").otherwise(F.initcap(c))


def html_escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c
