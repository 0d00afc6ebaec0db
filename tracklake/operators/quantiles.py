"""Exact quantiles of very many values, without ever holding more than a bounded number of them in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

#: Values that one aggregation buffer may hold.
FEW = 1_000_000
#: Parts into which a sketch cuts the values between two bounds.
GRID = 512


def exact_quantiles(rows: DataFrame, keys: list[str], probabilities: list[float], few: int = FEW) -> DataFrame:
    """keys and q0, q1, ...: type-7 quantiles of the present values v of each key; rows of nulls only have none.

    Keys are samples or panels: a list that the driver may hold. Up to `few` values of a key, its quantiles are taken at once.
    Beyond that, two bounds close in on the wanted ranks: a mergeable sketch proposes bounds between the last ones, a count
    tells exactly which ranks lie below, on and between them. At the end only the values strictly between are gathered.
    """
    few = max(few, 2 * GRID)  # of fewer values, the sketch's parts hold no less than the wanted ranks
    v = F.col("v").cast("double")
    rows = rows.select(*keys, v.alias("v")).filter("v is not null")
    sizes = [r.asDict() for r in rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high")).collect()]
    if all(r["_n"] <= few for r in sizes):
        return rows.groupBy(*keys).agg(*[F.percentile("v", p).alias(f"q{i}") for i, p in enumerate(probabilities)])
    spark, types = rows.sparkSession, [rows.schema[k] for k in keys]
    open_: dict[tuple, dict] = {}
    for r in sizes:
        for i, p in enumerate(probabilities):
            at = (r["_n"] - 1) * p
            open_[(*(r[k] for k in keys), i)] = {"at": at, "low": r["_low"], "high": r["_high"]}

    def bounded() -> DataFrame:
        """Values with the bounds of each quantile of their key."""
        known = [(*k, s["low"], s["high"]) for k, s in open_.items()]
        fields = [*types, StructField("_i", IntegerType()), StructField("_low", DoubleType()), StructField("_high", DoubleType())]
        bounds = F.broadcast(spark.createDataFrame(known, StructType(fields)))  # a row for each key and quantile
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(bounds[k])
        return rows.join(bounds, same).select(*[rows[k] for k in keys], "_i", "_low", "_high", "v")

    value = F.col("v")
    between = (value > F.col("_low")) & (value < F.col("_high"))

    def count() -> int:
        """Exact counts about the bounds; how many values lie between those of the largest one that still needs them."""
        found = bounded().groupBy(*keys, "_i").agg(F.count_if(value < F.col("_low")).alias("below"), F.count_if(value == F.col("_low")).alias("on"), F.count_if(between).alias("mid"))
        for r in found.collect():
            s = open_[tuple(r[k] for k in (*keys, "_i"))]
            s |= {"first": r["below"] + r["on"], "mid": r["mid"]}
            # Both wanted ranks lie on a bound.
            s["done"] = math.ceil(s["at"]) < s["first"] or math.floor(s["at"]) >= s["first"] + s["mid"]
        return max((s["mid"] for s in open_.values() if not s["done"]), default=0)

    left = count()
    while left > few:
        grid = F.percentile_approx("v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), F.lit(20 * GRID)).alias("grid")
        for r in bounded().filter(between).groupBy(*keys, "_i").agg(grid).collect():
            s = open_[tuple(r[k] for k in (*keys, "_i"))]
            if not s["done"]:
                share = lambda rank: (rank - s["first"]) / s["mid"] * GRID  # noqa: B023, E731
                below, above = math.floor(share(math.floor(s["at"]))) - 1, math.ceil(share(math.ceil(s["at"]) + 1)) + 1
                s["low"] = r["grid"][below] if below >= 0 else s["low"]
                s["high"] = r["grid"][above] if above <= GRID else s["high"]
        left = count()
    gathered = {}
    wanted = [(*k,) for k, s in open_.items() if not s["done"]]
    if wanted:
        asked = F.broadcast(spark.createDataFrame(wanted, StructType([*types, StructField("_i", IntegerType())])))
        some = bounded().filter(between)
        same = some["_i"] == asked["_i"]
        for k in keys:
            same = same & some[k].eqNullSafe(asked[k])
        # The two wanted values of each, picked where at most `few` are sorted.
        ranks = [(*k, s["first"], math.floor(s["at"]), math.ceil(s["at"])) for k, s in open_.items() if not s["done"]]
        table = spark.createDataFrame(ranks, StructType([*types, StructField("_i", IntegerType()), *[StructField(c, LongType()) for c in ("_first", "_a", "_b")]]))
        held = some.join(asked, same, "left_semi").groupBy(*keys, "_i").agg(F.sort_array(F.collect_list("v")).alias("values"))
        cond = held["_i"] == table["_i"]
        for k in keys:
            cond = cond & held[k].eqNullSafe(table[k])
        pick = lambda c: F.get("values", (F.col(c) - F.col("_first")).cast("int"))
        picked = held.join(F.broadcast(table), cond).select(*[held[k] for k in keys], held["_i"], F.when(F.col("_a") >= F.col("_first"), pick("_a")).alias("a"), F.when(F.col("_b") >= F.col("_first"), pick("_b")).alias("b"))
        gathered = {tuple(r[k] for k in (*keys, "_i")): (r["a"], r["b"]) for r in picked.collect()}
    out = []
    for r in sizes:
        row = [r[k] for k in keys]
        for i in range(len(probabilities)):
            s = open_[(*row[: len(keys)], i)]
            pair = gathered.get((*row[: len(keys)], i), (None, None))

            def at(rank: int, mid: float | None, s: dict = s) -> float:
                return s["low"] if rank < s["first"] else s["high"] if rank >= s["first"] + s["mid"] else mid

            a, b = at(math.floor(s["at"]), pair[0]), at(math.ceil(s["at"]), pair[1])
            row.append(a + (b - a) * (s["at"] - math.floor(s["at"])))
        out.append(tuple(row))
    return spark.createDataFrame(out, StructType([*types, *[StructField(f"q{i}", DoubleType()) for i in range(len(probabilities))]]))
