"""String, date and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slugify(name: Column, fallback: str = "person") -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", fallback).otherwise(s)


def unique_slugs(df: DataFrame, slug: str, order: str) -> DataFrame:
    """Repeated slugs get -2, -3 and so on, in order."""
    k = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return df.withColumn(slug, F.when(k > 1, F.concat(F.col(slug), F.lit("-"), k)).otherwise(F.col(slug)))


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def tag_list(text: Column, most: int = 80) -> Column:
    """Comma-separated names: trimmed, cut, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.substring(F.trim(x), 1, most)), lambda x: x != "")


def clipped(text: Column, most: int = 2000) -> Column:
    t = F.substring(F.trim(text), 1, most)
    return F.when(t != "", t)


def entries(log: Column) -> Column:
    """Sections of a log that begin with ``## ``; blank ones dropped."""
    return F.filter(F.transform(F.split(log, r"(?m)^## "), lambda x: F.trim(x)), lambda x: x != "")


def to_html(markdown: Column) -> Column:
    """Escapes, then bold and second-level headings."""
    s = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    s = F.regexp_replace(s, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(s, r"(?m)^## ([^\n]*)$", "<h3>$1</h3>")


def half_away(value: Column, places: int) -> Column:
    """A double rounded in binary, halves away from zero; what a negative one rounds to keeps its sign, also at zero."""
    scale = float(10**places)
    return F.signum(value) * F.round(F.abs(value) * scale) / scale


def signed(value: Column, places: int = 1) -> Column:
    """A difference with its sign, halves away from zero; a dash where there is none."""
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%+.{places}f", half_away(value, places)))


def fixed(value: Column, places: int = 1) -> Column:
    """So many places, by the exact value of the double as in C: 0.95 lies below its name and gives 0.9."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def number(value: Column) -> Column:
    """Two places under 1000, none from there on."""
    return F.when(value.isNull(), "—").when(F.abs(value) < 1000, F.format_string("%.2f", half_away(value, 2))).otherwise(F.format_string("%.0f", half_away(value, 0)))


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return F.format_string("%d h %02d m", F.floor(minutes / 60), minutes % 60)


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds) % 60)


def line(*parts: Column) -> Column:
    """The present parts, joined by a middle dot."""
    return F.concat_ws(" · ", *parts)


def filename_date(name: Column) -> Column:
    """The first valid date in a name, in any of the forms 20YYMMDD, 20YY-MM-DD, 20YY_MM_DD, 20YY.MM.DD."""
    found = F.regexp_extract_all(name, F.lit(r"(20\d{2}[-_.]?\d{2}[-_.]?\d{2})"), 1)
    dates = F.transform(found, lambda x: F.try_to_date(F.regexp_replace(x, "[-_.]", ""), "yyyyMMdd"))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def midnight_offset(ts: Column) -> Column:
    """Signed distance from the nearest midnight, in parts of twelve hours."""
    s = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.when(s > 43200, s - 86400).otherwise(s) / 43200.0


def age_years(born: Column, as_of: Column) -> Column:
    return F.datediff(as_of, born) / 365.25
