"""Fuzzy dates to a struct, with a ladder of built-in patterns. Years before Christ are negative, so no date type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_space

#: Fixed: month names and short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
#: Fixed: patterns.
ERA = "(?i)\\b(bc|bce|ad|ce|b\\.c\\.|a\\.d\\.|b\\.c\\.e\\.|c\\.e\\.)\\b"
CIRCA = "(?i)(?:\\b(?:circa|ca\\.?|approximately|approx\\.?|about|around)|~)\\s*"
ORDINAL = "(?i)(\\d+)(?:st|nd|rd|th)\\b"
DECADE = "\\b(\\d{3,4})s\\b"
ISO = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$"
SLASH = "^(\\d{1,2})/(\\d{1,2})/(\\d{4})$"
MONTH_DAY_YEAR = "(?i)^([a-z]+)\\s+(\\d{1,2}),?\\s+(\\d{1,4})$"
DAY_MONTH_YEAR = "(?i)^(\\d{1,2})\\s+([a-z]+)\\s+(\\d{1,4})$"
MONTH_YEAR = "(?i)^([a-z]+)\\s+(\\d{1,4})$"
YEAR = "^(\\d{1,4})$"

FIELDS = ["original", "iso", "year", "month", "day", "precision", "era", "approximate", "error"]


def normalize_date(c: Column) -> Column:
    """struct of original, iso, year (signed), month, day, precision, era, approximate, error. Null counts as empty."""
    original = strip_space(F.coalesce(c, F.lit("")))
    approximate = original.rlike(CIRCA)
    x = strip_space(F.regexp_replace(original, CIRCA, ""))
    era_text = F.upper(F.replace(F.regexp_extract(x, ERA, 1), F.lit("."), F.lit("")))
    era = F.when(era_text.isin("BC", "BCE"), "BC").otherwise("AD")
    x = strip_space(F.when(era_text != "", F.regexp_replace(x, ERA, "")).otherwise(x))
    x = F.regexp_replace(x, ORDINAL, "$1")
    decade = F.regexp_extract(x, DECADE, 1)
    x = F.when(decade != "", F.regexp_replace(x, F.lit(DECADE), decade)).otherwise(x)
    x = F.regexp_replace(x, "^[ ,.\\-–—]+|[ ,.\\-–—]+$", "")
    once = F.struct(original.alias("original"), approximate.alias("approximate"), era.alias("era"), decade.alias("decade"), x.alias("x"))
    return F.element_at(F.transform(F.array(once), lambda r: _parsed(r["original"], r["approximate"], r["era"], r["decade"], r["x"])), 1)


def _parsed(original: Column, approximate: Column, era: Column, decade: Column, x: Column) -> Column:
    """The ladder over a cleaned string; as a lambda's body its inputs are computed once."""

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(x, pattern, group)

    def number(pattern: str, group: int) -> Column:
        return part(pattern, group).try_cast("int")

    names = F.create_map(*(F.lit(v) for pair in MONTHS.items() for v in pair))
    named = lambda pattern, group: F.try_element_at(names, F.lower(part(pattern, group)))
    kind = (
        F.when(x.rlike(ISO), "iso")
        .when(x.rlike(SLASH), "slash")
        .when(x.rlike(MONTH_DAY_YEAR) & named(MONTH_DAY_YEAR, 1).isNotNull(), "mdy")
        .when(x.rlike(DAY_MONTH_YEAR) & named(DAY_MONTH_YEAR, 2).isNotNull(), "dmy")
        .when(x.rlike(MONTH_YEAR) & named(MONTH_YEAR, 1).isNotNull(), "my")
        .when(x.rlike(YEAR), "y")
    )
    day_first = number(SLASH, 1) > 12
    pick = lambda **by: F.coalesce(*(F.when(kind == k, v) for k, v in by.items()))
    year = pick(iso=number(ISO, 1), slash=number(SLASH, 3), mdy=number(MONTH_DAY_YEAR, 3), dmy=number(DAY_MONTH_YEAR, 3), my=number(MONTH_YEAR, 2), y=number(YEAR, 1))
    month = pick(iso=number(ISO, 2), slash=F.when(day_first, number(SLASH, 2)).otherwise(number(SLASH, 1)), mdy=named(MONTH_DAY_YEAR, 1), dmy=named(DAY_MONTH_YEAR, 2), my=named(MONTH_YEAR, 1))
    day = pick(iso=number(ISO, 3), slash=F.when(day_first, number(SLASH, 1)).otherwise(number(SLASH, 2)), mdy=number(MONTH_DAY_YEAR, 2), dmy=number(DAY_MONTH_YEAR, 1))
    precision = F.when(kind.isin("iso", "slash", "mdy", "dmy"), "day").when(kind == "my", "month").when(kind == "y", F.when(decade != "", "decade").otherwise("year"))
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    sign = F.when(era == "BC", "-").otherwise("")
    iso = F.concat(sign, pad(year, 4), F.when((precision == "day") & (month > 0) & (day > 0), F.concat(F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2))).when((precision == "month") & (month > 0), F.concat(F.lit("-"), pad(month, 2))).otherwise(""))
    empty = original == ""
    error = F.when(empty, "Empty date string").when(year.isNull(), F.concat(F.lit("Could not parse date: '"), original, F.lit("'")))
    values = [original, iso, F.when(era == "BC", -year).otherwise(year), month, day, precision, F.when(~empty, era), approximate & ~empty, error]
    return F.struct(*(v.alias(n) for v, n in zip(values, FIELDS, strict=True)))
