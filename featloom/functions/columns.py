"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: mean earth radius in miles
EARTH_RADIUS_MILES = 3958.7613


def zero_as_missing(c: Column) -> Column:
    return F.when(c != 0, c)


def negative_as_missing(c: Column) -> Column:
    return F.when(c >= 0, c)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    dlat = F.radians(lat2) - F.radians(lat1)
    dlon = F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def num_words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def num_characters(text: Column) -> Column:
    return F.length(text)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant, NULL below three values."""
    n = F.count(c)
    g1 = F.coalesce(F.skewness(c), F.lit(0.0))
    corrected = g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return F.when(n >= 3, corrected)


def entropy_term(count: Column, total: Column) -> Column:
    """One summand of the entropy in bits, with the 1e-10 guard inside the log."""
    p = count / total
    return -p * F.log2(p + F.lit(1e-10))


def digest_md5(text: Column) -> Column:
    return F.upper(F.md5(text))


def digest_sha512(text: Column) -> Column:
    return F.upper(F.sha2(text, 512))


def bit_set(value: Column, position: Column | int) -> Column:
    """Whether bit `position` (0 = lowest) is set."""
    return F.bit_get(value, F.lit(position) if isinstance(position, int) else position) == 1


def nth_part(text: Column, separator: str, n: int) -> Column:
    """n-th (1-based) part of a separated text; NULL when there are fewer."""
    return F.get(F.split(text, "\\Q" + separator + "\\E"), n - 1)


def json_value(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)
