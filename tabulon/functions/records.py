"""Strings, number lists, maps and whole rows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def real_text(c: Column, digits: int = 4) -> Column:
    """A number with a fixed number of digits and no blanks."""
    return F.format_string(f"%.{digits}f", c)


def padded(c: Column, width: int) -> Column:
    """Blanks to the right up to the width; longer text stays."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def same_text(a: Column, b: Column, any_case: bool = False) -> Column:
    """Equal without outer blanks."""
    a, b = F.trim(a), F.trim(b)
    return F.upper(a) == F.upper(b) if any_case else a == b


def number_list(c: Column) -> Column:
    """"1,2,3" as an array; fields that are no numbers are null."""
    return F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("long"))


def digits_of(c: Column) -> Column:
    """Whether each character is a digit."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.rlike("^[0-9]$"))


def place_of(many: Column, text: Column) -> Column:
    """The 1-based place of a text in an array, 0 if it isn't there."""
    return F.array_position(many, text)


def map_text(m: Column) -> Column:
    """key=value pairs by key, separated by blanks."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def row_map(columns: list[str]) -> Column:
    """A row's columns as a map of texts."""
    return F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))


def row_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def row_vector(columns: list[str]) -> Column:
    """A row as an array of doubles; missing values are 0."""
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor: Euclid's steps, as many as 64-bit numbers need."""
    pair = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda s: s["a"])


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def correlation_distance(c: Column, euclid: bool) -> Column:
    """A correlation as a distance: 1 less it (at least 0), or its negative logarithm (huge near 0)."""
    return F.when(c < 1e-12, F.lit(3.4028235e38)).otherwise(-F.ln(c)) if euclid else 1 - F.greatest(c, F.lit(0.0))
