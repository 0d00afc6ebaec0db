"""Profiles: statistics of each bin over the rows of a group and sample, with bands; quantiles; colour limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.missing import aggregate_value
from tracklake.operators.quantiles import exact_quantiles
from tracklake.shipping import ship_code

BANDS = ("none", "std", "se", "ci")


def long_form(matrix: DataFrame) -> DataFrame:
    return matrix.select("row_id", "group_id", "sample", F.posexplode("bins").alias("bin", "v")).withColumn("v", F.col("v").cast("double"))


def student_t(p: float, df: int) -> float:
    """Quantile of Student's t: the incomplete beta function by continued fraction, inverted by bisection."""

    def tail(t: float) -> float:
        x, a, b = df / (df + t * t), df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

        def fraction(a: float, b: float, x: float) -> float:
            tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
            d = 1 / (d if abs(d) > tiny else tiny)
            h = d
            for m in range(1, 500):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 + num * d
                    d = 1 / (d if abs(d) > tiny else tiny)
                    c = 1 + num / c
                    c = c if abs(c) > tiny else tiny
                    h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h

        whole = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
        return whole / 2

    low, high = 0.0, 1.0
    while 1 - tail(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - tail(middle) < p else (low, middle)
    return (low + high) / 2


def geometric_mean(rows: DataFrame, keys: list[str], block: list[str], pseudocount: float | None = None) -> DataFrame:
    """(keys, centre, spread, n): signed geometric mean. One automatic pseudocount for each block: half its smallest magnitude but 0.

    Values of both signs within one key are an error; equal values give that value; with pseudocount 0 any zero gives 0.
    """
    v = F.col("v")
    sign = F.signum(v)
    rows = rows.filter(v.isNotNull())
    if pseudocount is None:
        found = rows.filter(v != 0).groupBy(*block).agg((F.min(F.abs(v)) / 2).alias("pc"))
        rows = rows.join(F.broadcast(found), block, "left").withColumn("pc", F.coalesce("pc", F.lit(0.0)))
    else:
        rows = rows.withColumn("pc", F.lit(float(pseudocount)))
    heads = rows.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max("pc").alias("pc"), F.max(sign).alias("up"), F.min(sign).alias("down"), F.count_if(v == 0).alias("zeros"))
    mixed = (F.col("up") > 0) & (F.col("down") < 0)
    way = F.when(mixed, F.raise_error(F.lit("a geometric mean needs values of one sign in each bin")).cast("double")).when(F.col("up") > 0, 1.0).when(F.col("down") < 0, -1.0).otherwise(0.0)
    heads = heads.withColumn("way", way)
    # Logarithm of a value and its pseudocount, relative to the pseudocount where there is one.
    logged = F.when(F.col("pc") > 0, F.log1p(F.col("way") * v / F.col("pc"))).otherwise(F.log(F.when(F.col("way") * v > 0, F.col("way") * v)))
    means = rows.drop("pc").join(heads, keys).groupBy(*keys, "low", "high", "pc", "way", "zeros").agg(F.avg(logged).alias("m"), F.stddev_pop(logged).alias("s"), F.count("*").alias("n"))
    back = F.when(F.col("pc") > 0, F.col("way") * F.col("pc") * F.expm1("m")).otherwise(F.col("way") * F.exp("m"))
    centre = F.when(F.col("low") == F.col("high"), F.col("low")).when((F.col("way") == 0) | ((F.col("pc") == 0) & (F.col("zeros") > 0)), 0.0).otherwise(back)
    return means.select(*keys, centre.alias("centre"), F.col("s").alias("spread"), "n")


def profile(matrix: DataFrame, statistic: str = "mean", band: str = "none", confidence: float = 0.95, trim: float = 0.05, pseudocount: float | None = None) -> DataFrame:
    """(group_id, sample, bin, centre, lower, upper, n). Without present values the centre is missing, for sums too.

    Bands: std, se = std / sqrt(n - 1), ci = se times Student's t of n - 1; for means and geometric means only.
    """
    if band not in BANDS:
        raise ValueError("unknown band")
    if band != "none" and statistic not in ("mean", "geom_mean"):
        raise ValueError("bands belong to means")
    keys = ["group_id", "sample", "bin"]
    rows = long_form(matrix)
    if statistic == "geom_mean":
        found = geometric_mean(rows, keys, ["group_id", "sample"], pseudocount)
    else:
        n = F.count("v")
        found = rows.groupBy(*keys).agg(F.when(n > 0, aggregate_value(F.col("v"), statistic, trim)).alias("centre"), F.stddev_pop("v").alias("spread"), n.alias("n"))
    width: Column = F.lit(None).cast("double")
    if band == "std":
        width = F.col("spread")
    elif band in ("se", "ci"):
        width = F.when(F.col("n") > 1, F.col("spread") / F.sqrt(F.col("n") - 1))
        if band == "ci":
            sizes = [r["n"] for r in found.filter("n > 1").select("n").distinct().collect()]  # at most one for each row count that occurs
            table = matrix.sparkSession.createDataFrame([(n, student_t((1 + confidence) / 2, n - 1)) for n in sizes] or [(0, 0.0)], "n long, t double")
            found = found.join(F.broadcast(table), "n", "left")
            width = width * F.col("t")
    return found.select(*keys, "centre", (F.col("centre") - width).alias("lower"), (F.col("centre") + width).alias("upper"), "n")


def bootstrap(matrix: DataFrame, statistic: str = "mean", resamples: int = 300, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile bootstrap band of each bin: (group_id, sample, bin, centre, lower, upper).

    All bins of a group and sample use the same draws of rows, so a group and sample is one task; its rows are one float
    for each bin. Missing values are left out bin by bin.
    """
    if statistic not in ("mean", "median", "sum"):
        raise ValueError("unknown statistic")
    reduce = {"mean": np.nanmean, "median": np.nanmedian, "sum": np.nansum}[statistic]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        x = np.array([[np.nan if v is None else v for v in b] for b in rows["bins"]], float)
        rng = np.random.default_rng(seed)
        with np.errstate(all="ignore"):
            import warnings

            warnings.simplefilter("ignore")
            empty = np.isnan(x).all(0)
            centre = np.where(empty, np.nan, reduce(x, axis=0))
            draws = np.stack([np.where(np.isnan(d := x[rng.integers(0, len(x), len(x))]).all(0), np.nan, reduce(d, axis=0)) for _ in range(resamples)])
            tails = np.nanquantile(draws, [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
        out = pd.DataFrame({"group_id": rows["group_id"].iloc[0], "sample": rows["sample"].iloc[0], "bin": np.arange(x.shape[1]), "centre": centre, "lower": tails[0], "upper": tails[1]})
        return out.astype(object).where(out.notna(), None)

    ship_code(matrix.sparkSession)
    return matrix.select("group_id", "sample", "ord", "bins").groupBy("group_id", "sample").applyInPandas(run, "group_id int, sample int, bin int, centre double, lower double, upper double")


def colour_limits(matrix: DataFrame, scope: str = "sample", low: float = 0.01, high: float = 0.99 - 0.01) -> DataFrame:
    """Percentiles of the present bins that bound a heat map's colours, for the whole matrix, each sample or each group."""
    keys = {"all": ["all"], "sample": ["sample"], "group": ["group_id"], "panel": ["group_id", "sample"]}[scope]
    rows = long_form(matrix).filter("v is not null").withColumn("all", F.lit(0))
    inner = exact_quantiles(rows, keys, [low, high]).select(*keys, F.col("q0").alias("zmin"), F.col("q1").alias("zmax"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    found = ends.join(F.broadcast(inner), keys)  # a row for each panel
    flat = F.col("zmin") == F.col("zmax")
    return found.select(*[k for k in keys if k != "all"], F.when(flat, F.col("vmin")).otherwise(F.col("zmin")).alias("zmin"), F.when(flat, F.col("vmax")).otherwise(F.col("zmax")).alias("zmax"))


def y_limits(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Common limits of the curves of each axis group."""
    return profiles.groupBy(*by).agg(F.min(F.coalesce("lower", "centre")).alias("ymin"), F.max(F.coalesce("upper", "centre")).alias("ymax"))


def bin_down(matrix: DataFrame, factor: int) -> DataFrame:
    """Mean of each run of `factor` neighbouring bins, for rasters narrower than the matrix."""
    starts = F.sequence(F.lit(1), F.size("bins"), F.lit(factor))
    mean = lambda part: F.when(F.size(F.filter(part, lambda v: v.isNotNull())) > 0, F.aggregate(F.filter(part, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / F.size(F.filter(part, lambda v: v.isNotNull())))
    return matrix.withColumn("bins", F.transform(starts, lambda i: mean(F.slice("bins", i, F.lit(factor))).cast("float")))


def cell_quantile(matrix: DataFrame, q: float, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quantile of all present bins of each sample: exact, or from a mergeable sketch."""
    rows = long_form(matrix).filter("v is not null")
    if exact:
        return exact_quantiles(rows, ["sample"], [q]).withColumnRenamed("q0", "value")
    return rows.groupBy("sample").agg(F.percentile_approx("v", q, accuracy).alias("value"))
