"""Scalar functions as column expressions: strings, weights, angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN_AS_ZERO = lambda c: F.when(F.isnan(c), 0.0).otherwise(c)


def compact(c: Column) -> Column:
    """Runs of blanks and tabs become one blank, control characters go, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F]", ""), r"[ \t]+", " "))


def parse(c: Column, delimiters: str) -> Column:
    """Tokens between any of the delimiters."""
    return F.split(compact(c), f"[{delimiters}]")


def remove_punctuation(c: Column) -> Column:
    """Without ASCII 32-43, 45-47, 58-64, 91-94 and 123-126: comma, underscore and backtick stay."""
    return F.regexp_replace(c, r"[\x20-\x2B\x2D-\x2F\x3A-\x40\x5B-\x5E\x7B-\x7E]", "")


def csv_field(c: Column, n: int) -> Column:
    """The n-th comma field, trimmed; empty beyond the last."""
    return F.coalesce(F.trim(F.get(F.split(c, ","), F.lit(n - 1))), F.lit(""))


def count_tokens(c: Column) -> Column:
    """Blank-separated tokens; 0 for blank and comment lines."""
    t = F.trim(c)
    return F.when((t == "") | t.startswith("#") | t.isNull(), 0).otherwise(F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")))


def pad_number(c: Column, width: int) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def euler_normal(e1: Column, e2: Column) -> Column:
    """The projection direction of Euler angles in degrees."""
    a, b = F.radians(e1), F.radians(e2)
    return F.struct((F.sin(b) * F.cos(a)).alias("x"), (F.sin(b) * F.sin(a)).alias("y"), F.cos(b).alias("z"))


def direction_distance(a: Column, b: Column) -> Column:
    """The angle between two directions, in radians."""
    dot = a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def round_to_even(c: Column) -> Column:
    """The nearest even integer; ties go to the lower."""
    return (2 * F.ceil((c - 1) / 2)).cast("long")


def sinc(c: Column) -> Column:
    return F.when(F.abs(c) < 1e-8, 1.0).otherwise(F.sin(c) / c)


def gaussian(c: Column, mean: float, variance: float) -> Column:
    return F.exp(-((c - mean) ** 2) / (2 * variance)) / F.sqrt(F.lit(2 * 3.141592653589793 * variance))


def cos_decay(i: Column, most: int, lo: float, hi: float) -> Column:
    """From hi at 0 to lo at `most` along half a cosine."""
    return lo + (hi - lo) * (1 + F.cos(F.lit(3.141592653589793) * F.least(i, F.lit(most)) / most)) / 2


def norm_corr(xy: Column, xx: Column, yy: Column) -> Column:
    """Normalised correlation, 0 where a norm vanishes."""
    return F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)).otherwise(0.0)
