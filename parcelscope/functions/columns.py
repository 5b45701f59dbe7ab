"""Column expressions shared by the operators. Everything here stays inside Spark SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
EPS = 1e-8
# fixed value: mean Earth radius in km
EARTH_RADIUS_KM = 6371.0088


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def us(x) -> Column:
    """Microseconds since the epoch of a zone-less timestamp (session zone must be UTC)."""
    return F.unix_micros(c(x).cast("timestamp"))


def days_between(later, earlier) -> Column:
    """Elapsed days as a double: microsecond difference / 86400e6."""
    return (us(later) - us(earlier)) / F.lit(float(DAY_US))


def day(x) -> Column:
    return c(x).cast("date")


def month_key(x) -> Column:
    return F.date_format(c(x), "yyyy-MM")


def ratio(num, den) -> Column:
    """NULL when the denominator is 0 or NULL."""
    return c(num) / F.nullif(c(den), F.lit(0))


def rnd(x, digits: int = 6) -> Column:
    return F.round(c(x), digits)


def flag(cond: Column) -> Column:
    """1 where true, 0 where false or NULL."""
    return F.when(cond, 1).otherwise(0)


def n_if(cond: Column) -> Column:
    """Number of rows where the condition is true."""
    return F.sum(flag(cond)).cast("long")


def share(cond: Column, digits: int = 6) -> Column:
    """Mean of a condition as percent of all rows."""
    return F.round(100.0 * F.sum(flag(cond)) / F.nullif(F.count(F.lit(1)), F.lit(0)), digits)


def guarded_log1p(x) -> Column:
    return F.when(c(x) >= 0, F.log1p(c(x)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; the half-angle term is clipped to [0, 1]."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp, dl = p2 - p1, F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    inside = F.when(a < 0, 0.0).when(a > 1, 1.0).otherwise(a)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(inside))


def _plain(ch: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(p for p in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(p))


# every character of the basic plane that decomposes to one ASCII letter or digit, and the marks that are dropped
_FOLD = {ch: p for ch in map(chr, range(0x80, 0xFFFF)) if len(p := _plain(ch)) == 1 and p.isascii() and p.isalnum()}
_MARKS = "".join(ch for ch in map(chr, range(0x300, 0x370)) if unicodedata.combining(ch))
_ACCENTED, _PLAIN = "".join(_FOLD) + _MARKS, "".join(_FOLD.values())
# ligatures and digraphs of two or three letters
_WIDE = {ch: p for ch in map(chr, [*range(0xC0, 0x250), *range(0xFB00, 0xFB07)]) if len(p := _plain(ch)) > 1 and p.isascii() and p.isalpha()}


def norm_text(x) -> Column:
    """Upper case without accents; runs of other characters become one space; '' becomes NULL.

    Accents go first and the case is changed after that, as ordinals and ligatures fold to small letters.
    """
    t = F.translate(c(x).cast("string"), _ACCENTED, _PLAIN)
    for ch, p in _WIDE.items():
        t = F.replace(t, F.lit(ch), F.lit(p))
    t = F.upper(t)
    t = F.trim(F.regexp_replace(t, "[^A-Z0-9]+", " "))
    return F.when(t != "", t)


def zip5(x) -> Column:
    """Left-pad to five characters; longer values stay as they are."""
    s = F.trim(c(x).cast("string"))
    return F.when(F.length(s) < 5, F.lpad(s, 5, "0")).otherwise(s)


def clean_code(x, width: int) -> Column:
    """Numeric code: drop a trailing .0, drop non-digits, zero-fill; NULL if empty or too long."""
    s = F.regexp_replace(F.trim(c(x).cast("string")), r"\.0+$", "")
    s = F.regexp_replace(s, r"\D", "")
    return F.when((F.length(s) > 0) & (F.length(s) <= width), F.lpad(s, width, "0"))


def parse_population(x) -> Column:
    """Integer population from text with footnotes such as ``12,345(1)`` or ``12.345``."""
    s = F.regexp_replace(c(x).cast("string"), r"\(\s*\d+\s*\)", "")
    s = F.regexp_replace(s, r"\D", "")
    return F.nullif(s, F.lit("")).try_cast("bigint")


def try_number(x) -> Column:
    return c(x).try_cast("double")


def try_ts(x) -> Column:
    return c(x).try_cast("timestamp_ntz")


def not_blank(x) -> Column:
    return F.nullif(c(x), F.lit(""))


def is_finite(x) -> Column:
    v = c(x)
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def clip01(x, eps: float) -> Column:
    v = c(x)
    return F.when(v < eps, eps).when(v > 1 - eps, 1 - eps).otherwise(v)


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-c(x)))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval for k successes in n trials."""
    p = k / F.nullif(n, F.lit(0))
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return mid - half, mid + half
