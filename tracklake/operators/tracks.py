"""Track algebra: describe, scale and merge interval tracks (sample, chrom, start, end, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions.missing import finite, narrow


def info(track: DataFrame) -> DataFrame:
    """Bases covered, and mean, population standard deviation, minimum and maximum weighted by width, of each sample."""
    rows = track.select("sample", (F.col("end") - F.col("start")).alias("w"), finite(F.col("value")).alias("v")).filter("v is not null and w > 0")
    first = rows.groupBy("sample").agg(F.sum("w").cast("long").alias("bases"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    # Two passes: the deviations from the mean are summed, not the squares.
    spread = rows.join(F.broadcast(first.select("sample", "mean")), "sample").groupBy("sample").agg(F.sqrt(F.sum(F.col("w") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))) / F.sum("w")).alias("std"))
    return first.join(spread, "sample").select("sample", "bases", "mean", "std", "min", "max")


def scale(track: DataFrame, factor: float) -> DataFrame:
    """Every value times a factor. Intervals stay; values that are not finite are left out."""
    return track.withColumn("value", finite(F.col("value"))).filter("value is not null").withColumn("value", narrow(F.col("value") * factor))


def bins(track: DataFrame, bin_size: int, sizes: DataFrame | None = None) -> DataFrame:
    """Sum of value times covered bases of each touched bin: (sample, chrom, bin, total)."""
    rows = track.select("sample", "chrom", "start", "end", finite(F.col("value")).alias("v")).filter("v is not null and end > start")
    if sizes is not None:
        rows = rows.join(F.broadcast(sizes.select("chrom", "length")), "chrom").withColumn("end", F.least("end", "length")).filter("end > start").drop("length")
    each = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    overlap = F.least(F.col("end"), (F.col("bin") + 1) * bin_size) - F.greatest(F.col("start"), F.col("bin") * bin_size)
    return each.groupBy("sample", "chrom", "bin").agg(F.sum(F.col("v") * overlap).alias("total"))


def merge(track: DataFrame, sizes: DataFrame, bin_size: int, how: str = "sum", inputs: int | None = None, factor: float = 1.0) -> DataFrame:
    """Per-bin means of the inputs, absent ones 0, summed or averaged over all inputs: (chrom, bin, start, end, value).

    Inputs are the samples that occur, unless their number is given. Bins without signal in any input are left out.
    """
    if how not in ("sum", "mean"):
        raise ValueError("how must be sum or mean")
    n = 1 if how == "sum" else (inputs or track.select("sample").distinct().count())
    summed = bins(track, bin_size, sizes).groupBy("chrom", "bin").agg(F.sum("total").alias("total"))
    rows = summed.join(F.broadcast(sizes.select("chrom", "length")), "chrom").withColumn("start", F.col("bin") * bin_size).withColumn("end", F.least((F.col("bin") + 1) * bin_size, F.col("length")))
    return rows.select("chrom", "bin", "start", "end", narrow(F.col("total") / (F.col("end") - F.col("start")) / n * factor).alias("value"))


def merged_sizes(sizes: DataFrame) -> DataFrame:
    """Union of the chromosomes of several tracks (sample, chrom, ord, length), in order of first appearance; lengths must agree."""
    found = sizes.groupBy("chrom").agg(F.min(F.struct("sample", "ord")).alias("at"), F.min("length").alias("low"), F.max("length").alias("length"))
    checked = F.when(F.col("low") == F.col("length"), F.col("length")).otherwise(F.raise_error(F.concat(F.lit("lengths differ for chromosome "), F.col("chrom"))).cast("bigint"))
    return found.select("chrom", F.col("at"), checked.cast("long").alias("length")).orderBy("at").select("chrom", "length")


def common_sizes(sizes: DataFrame) -> DataFrame:
    """Chromosomes that every sample has, with the same length."""
    n = sizes.select("sample").distinct().count()
    return sizes.groupBy("chrom", "length").agg(F.countDistinct("sample").alias("n")).filter(F.col("n") == n).select("chrom", "length")


def resolve_aliases(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, chrom): the known chromosome of each name: the name itself, else with or without the prefix, else M for MT."""
    bare = F.regexp_replace("name", "^chr", "")
    other = F.when(F.col("name") == "chrM", "MT").when(F.col("name") == "MT", "chrM").when(F.col("name").startswith("chr"), bare).otherwise(F.concat(F.lit("chr"), F.col("name")))
    exact = known.select(F.col("chrom").alias("exact")).distinct()
    second = known.select(F.col("chrom").alias("alias")).distinct()
    found = names.select("name").distinct().withColumn("other", other)
    return found.join(F.broadcast(exact), found["name"] == F.col("exact"), "left").join(F.broadcast(second), F.col("other") == F.col("alias"), "left").select("name", F.coalesce("exact", "alias").alias("chrom"))
