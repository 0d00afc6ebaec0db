"""Interval algebra on half-open intervals: overlap joins, merge, subtract, intersect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a join bucket in bases: an interval is sent to each bucket that it touches.
BUCKET = 4096
#: Bases of a tile: intervals are put in order within tiles, so that no task orders a whole chromosome's.
TILE = 1 << 20


def _bucketed(df: DataFrame, width: int, keep: bool = False) -> DataFrame:
    """A row for each bucket that an interval touches. keep: empty and null intervals stay, in no bucket."""
    buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    if keep:
        return df.withColumn("bucket", F.explode_outer(F.when(F.col("end") > F.col("start"), buckets)))
    return df.filter("end > start").withColumn("bucket", F.explode(buckets))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str] | None = None, width: int = BUCKET, keep_left: bool = False) -> DataFrame:
    """Pairs of overlapping intervals, each once: an equi-join on keys and bucket, kept in the bucket of the overlap's start.

    Both sides have start and end; the right side's come back as r_start and r_end, its other columns as r_<name>. With
    keep_left, each bucket of a left interval also leaves rows without a partner (r_start is null), at least one.
    """
    keys = ["chrom"] if keys is None else keys
    named = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    buckets = named.withColumnRenamed("r_start", "start").withColumnRenamed("r_end", "end")
    buckets = _bucketed(buckets, width).withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    buckets = buckets.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "bucket")], *[c for c in buckets.columns if c.startswith("r_")])
    start = F.greatest("start", "r_start")
    hit = (start < F.least("end", "r_end")) & (F.floor(start / width) == F.col("bucket"))
    for c in (*keys, "bucket"):
        hit = (F.col(c) == F.col(f"_{c}")) & hit
    joined = _bucketed(left, width, keep_left).join(buckets, hit, "left" if keep_left else "inner")
    return joined.drop("bucket", *[f"_{c}" for c in (*keys, "bucket")])


def semi_overlap(left: DataFrame, right: DataFrame, keys: list[str] | None = None, anti: bool = False, width: int = BUCKET) -> DataFrame:
    """Rows of left that overlap (or, anti, don't overlap) any interval of right. left needs a unique column row_id."""
    keys = ["chrom"] if keys is None else keys
    hit = overlap_join(left.select("row_id", "start", "end", *keys), right.select("start", "end", *keys), keys, width).select("row_id").distinct()
    return left.join(hit, "row_id", "left_anti" if anti else "left_semi")


def _tiled(df: DataFrame) -> DataFrame:
    """Intervals cut at the ends of tiles, with their tile."""
    first, last = F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE)
    cut = df.filter("end > start").withColumn("tile", F.explode(F.sequence(first, last)))
    return cut.withColumn("start", F.greatest("start", F.col("tile") * TILE)).withColumn("end", F.least("end", (F.col("tile") + 1) * TILE))


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _stitched(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of tiles as whole ones: only those that reach an end of their tile are put in order across tiles."""
    edge = (F.pmod("start", F.lit(TILE)) == 0) | (F.pmod("end", F.lit(TILE)) == 0)
    whole = runs.select(*keys, "start", "end")
    return whole.filter(~edge).unionByName(_merged(whole.filter(edge), keys))


def merge(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of overlapping or adjacent intervals within keys, tile by tile."""
    keys = ["chrom"] if keys is None else keys
    return _stitched(_merged(_tiled(df.select(*keys, "start", "end")), [*keys, "tile"]), keys)


def _sweep(sets: list[DataFrame], keys: list[str], keep: Column) -> DataFrame:
    """Segments between the boundaries of several sets, where `keep` holds of the depths d0, d1, ..."""
    events, lane = None, [*keys, "tile"]
    for i, df in enumerate(sets):
        # Cut at the ends of tiles, intervals begin and end in each tile: depths start from 0 there.
        one = _tiled(df.select(*keys, "start", "end")).select(*lane, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by")))).alias("e"))
        one = one.select(*lane, "e.at", *[(F.col("e.by") if i == j else F.lit(0)).alias(f"b{j}") for j in range(len(sets))])
        events = one if events is None else events.unionByName(one)
    depths = [f"b{j}" for j in range(len(sets))]
    changes = events.groupBy(*lane, "at").agg(*[F.sum(b).alias(b) for b in depths])
    w = Window.partitionBy(*lane).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = changes.select(*lane, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(b).over(run).alias(f"d{j}") for j, b in enumerate(depths)])
    return _stitched(_merged(swept.filter(F.col("end").isNotNull() & keep).select(*lane, "start", "end"), lane), keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bases of a that no interval of b covers, as merged intervals."""
    return _sweep([a, b], ["chrom"] if keys is None else keys, (F.col("d0") > 0) & (F.col("d1") == 0))


def intersect(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bases that both sets cover, as merged intervals."""
    return _sweep([a, b], ["chrom"] if keys is None else keys, (F.col("d0") > 0) & (F.col("d1") > 0))


def clip(df: DataFrame, chrom_sizes: DataFrame) -> DataFrame:
    """Intervals cut to their chromosome; what is left without a base goes."""
    joined = df.join(chrom_sizes.select("chrom", "length"), "chrom")
    return joined.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "length")).filter("end > start").drop("length")


def merged_array(blocks: Column) -> Column:
    """Union of an array of blocks struct<s,e> as sorted, merged blocks."""
    kind = "array<struct<s:bigint,e:bigint>>"

    def step(out: Column, b: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], b["e"]).alias("e"))))
        return F.when((F.size(out) == 0) | (b["s"] > F.coalesce(last["e"], F.lit(0))), F.concat(out, F.array(b))).otherwise(grown).cast(kind)

    return F.aggregate(F.sort_array(blocks), F.array().cast(kind), step)


def subtracted_array(blocks: Column, gaps: Column) -> Column:
    """Blocks without the bases of gaps, both arrays of struct<s,e>."""
    kind = "array<struct<s:bigint,e:bigint>>"

    def step(left: Column, g: Column) -> Column:
        pieces = F.transform(left, lambda b: F.array(F.struct(b["s"].alias("s"), F.least(b["e"], F.greatest(g["s"], b["s"])).alias("e")), F.struct(F.greatest(b["s"], F.least(g["e"], b["e"])).alias("s"), b["e"].alias("e"))))
        # A gap that misses a block leaves it whole: the two pieces then overlap or touch, and only one is kept.
        whole = F.transform(left, lambda b: F.when((g["e"] <= b["s"]) | (g["s"] >= b["e"]), F.array(b)))
        both = F.zip_with(pieces, whole, lambda p, w: F.coalesce(w, p))
        return F.filter(F.flatten(both), lambda b: b["e"] > b["s"]).cast(kind)

    return F.aggregate(gaps, blocks.cast(kind), step)
