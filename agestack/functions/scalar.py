"""Column expressions: age transform, scoring arithmetic, clean-up, names."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

ADULT_AGE = 20.0


def age_to_scale(age: Column, adult: float = ADULT_AGE) -> Column:
    """Logarithmic below the adult age, linear above it.  NULL where the logarithm is undefined."""
    child = F.log1p(age) - F.log1p(F.lit(float(adult)))
    return F.when(age <= adult, child).otherwise((age - adult) / (adult + 1.0))


def scale_to_age(y: Column, adult: float = ADULT_AGE) -> Column:
    return F.when(y < 0, (adult + 1.0) * F.exp(y) - 1.0).otherwise(y * (adult + 1.0) + adult)


class Target(NamedTuple):
    """A target transform: two Column -> Column functions and the inverse on numpy arrays."""

    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    inverse_array: Callable


def _scale_to_age_array(y):
    import numpy as np

    low = (ADULT_AGE + 1.0) * np.exp(np.minimum(y, 0.0)) - 1.0
    return np.where(y < 0, low, y * (ADULT_AGE + 1.0) + ADULT_AGE)


AGE_TARGET = Target(age_to_scale, scale_to_age, _scale_to_age_array)
PLAIN_TARGET = Target(lambda c: c, lambda c: c, lambda a: a)


def missing_to_null(x: Column) -> Column:
    """NaN is a value to Spark; the pipeline treats it as missing."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def fill_missing(x: Column, *fallbacks: Column) -> Column:
    return F.coalesce(missing_to_null(x), *fallbacks, F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def standardize(x: Column, mean: Column, scale: Column) -> Column:
    return (x - mean) / F.when((scale == 0) | scale.isNull(), 1.0).otherwise(scale)


def dot(x: Column, w: Column) -> Column:
    """Inner product of two arrays of equal length, inside the JVM."""
    products = F.zip_with(x, w, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def with_suffix(feature: Column, suffix: Column) -> Column:
    """Add the modality suffix unless the name already ends in it."""
    return F.when(F.endswith(feature, suffix), feature).otherwise(F.concat(feature, suffix))


def strip_prefix(name: Column, prefix: str) -> Column:
    return F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)


def site_name(i: Column) -> Column:
    return F.concat(F.lit("cg"), F.lpad(i.cast("string"), 8, "0"))


def seeded_hash(key: Column, seed: Column | int) -> Column:
    """The order that stands for 'random' everywhere: md5 of key and seed, the same in every engine."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", key.cast("string"), seed.cast("string")).cast("binary"))


def hash_fraction(key: Column, seed: Column | int) -> Column:
    """A uniform number in [0, 1) from the first eight hex digits of the seeded hash."""
    head = F.substring(seeded_hash(key, seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
