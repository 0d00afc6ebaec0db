"""Missing data. NULL is the only missing value inside the engine; NaN and infinities become NULL at every source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATISTICS = ("mean", "median", "sum", "min", "max", "std", "trim_mean", "count", "nonzero")


def finite(value: Column) -> Column:
    """value as double, or NULL where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def finite_array(values: Column) -> Column:
    return F.transform(values, finite)


def present(values: Column) -> Column:
    """The values of an array that are not missing."""
    return F.filter(values, lambda v: v.isNotNull())


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def quantile_sorted(ordered: Column, q: float) -> Column:
    """Type-7 quantile of a sorted array without missing values; NULL if it is empty."""
    at = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    below, above = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, below + (above - below) * (at - low))


def reduce_array(values: Column, statistic: str, trim: float = 0.05) -> Column:
    """A statistic of an array's present values. Without any, the sum and the counts are 0 and all else is missing."""
    if statistic not in STATISTICS:
        raise ValueError(f"unknown statistic {statistic!r}")
    if statistic == "trim_mean" and not 0 <= trim < 0.5:
        raise ValueError("the trimmed share must be in [0, 0.5)")

    def of(v: Column) -> Column:
        n = F.size(v)
        if statistic == "count":
            return n.cast("double")
        if statistic == "nonzero":
            return F.size(F.filter(v, lambda x: x != 0)).cast("double")
        if statistic == "sum":
            return total(v)
        if statistic == "mean":
            return F.when(n > 0, total(v) / n)
        if statistic == "min":
            return F.array_min(v)
        if statistic == "max":
            return F.array_max(v)
        if statistic == "median":
            return let(F.sort_array(v), lambda s: quantile_sorted(s, 0.5))
        if statistic == "trim_mean":
            cut = F.floor(n * F.lit(trim)).cast("int")
            kept = F.slice(F.sort_array(v), cut + 1, n - 2 * cut)
            return F.when(n > 0, total(kept) / (n - 2 * cut))
        return F.when(n > 0, let(total(v) / n, lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)))

    return let(present(values), of)


def aggregate_value(value: Column, statistic: str, trim: float = 0.05) -> Column:
    """The same statistic as a grouped aggregate of a column."""
    if statistic in ("trim_mean", "median"):
        return F.percentile(value, 0.5) if statistic == "median" else reduce_array(F.collect_list(value), "trim_mean", trim)
    simple = {
        "mean": F.avg, "sum": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "min": F.min, "max": F.max, "std": F.stddev_pop,
        "count": lambda v: F.count(v).cast("double"), "nonzero": lambda v: F.count_if(v != 0).cast("double"),
    }
    return simple[statistic](value)


def narrow(value: Column) -> Column:
    """To stored precision. A present value beyond single precision is an error, not an infinity."""
    small = value.cast("float")
    return F.when(value.isNull(), None).when(F.abs(small) < F.lit(float("inf")), small).otherwise(F.raise_error(F.lit("a value exceeds the range of single precision")).cast("float"))
