"""Set, vector and text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<string>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def items(attrs, key: str) -> Column:
    """The values of an attribute, the empty set where it is missing."""
    return F.coalesce(F.try_element_at(_c(attrs), F.lit(key)), F.array().cast(_EMPTY))


def overlap(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(_c(a), _c(b)), F.lit(False)).cast("double")


def set_cosine(a, b) -> Column:
    """|A and B| / (|A| * |B|), 0 where either is empty (no root: kept for parity as a feature)."""
    a, b = _c(a), _c(b)
    n = F.size(a) * F.size(b)
    return F.when(n > 0, F.size(F.array_intersect(a, b)).cast("double") / n).otherwise(F.lit(0.0))


def jaccard(a, b) -> Column:
    a, b = _c(a), _c(b)
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common.cast("double") / union).otherwise(F.lit(0.0))


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(a, b) -> Column:
    """Row-wise product sum."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(x) -> Column:
    return F.sqrt(dot(x, x))


def difference_norm(a, b) -> Column:
    return norm(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double")))


def cosine(a, b) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def box_min_distance(x, low, high) -> Column:
    """Distance from a point to the nearest point of a box."""
    below = F.zip_with(_c(low), _c(x), lambda lo, v: lo.cast("double") - v.cast("double"))
    above = F.zip_with(_c(x), _c(high), lambda v, hi: v.cast("double") - hi.cast("double"))
    return norm(F.zip_with(below, above, lambda p, q: F.greatest(p, q, F.lit(0.0))))


def box_max_distance(x, low, high) -> Column:
    """Distance from a point to the farthest corner of a box."""
    a = F.zip_with(_c(high), _c(x), lambda hi, v: hi.cast("double") - v.cast("double"))
    b = F.zip_with(_c(x), _c(low), lambda v, lo: v.cast("double") - lo.cast("double"))
    return norm(F.zip_with(a, b, lambda p, q: F.greatest(p, q)))


def box_diameter(low, high) -> Column:
    return difference_norm(high, low)


def expit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def relu(x) -> Column:
    return F.greatest(_c(x), F.lit(0.0))


ACTIVATIONS = {"relu": relu, "sigmoid": expit, "tanh": lambda x: F.tanh(_c(x)), "identity": lambda x: _c(x)}


def tokens(text) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")


def initials(names) -> Column:
    return F.array_distinct(F.transform(_c(names), lambda n: F.substring(n, 1, 1)))


def last_tokens(names) -> Column:
    return F.array_distinct(F.transform(_c(names), lambda n: F.element_at(F.split(F.trim(n), r"\s+"), -1)))


def scale(x, by) -> Column:
    return F.transform(_c(x), lambda v: v / by)


def unit(x) -> Column:
    n = norm(x)
    return F.when(n > 0, scale(x, n)).otherwise(_c(x))
