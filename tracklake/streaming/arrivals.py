"""Incremental coverage of alignments that arrive in a folder or topic.

Binning needs no order, so a stream of single records keeps one integer for each touched bin as state. Pairs need both
mates; a stream of pairs joins its two read ends within a bounded delay instead of keeping them for ever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import alignments as A
from tracklake.operators import coverage as C


def bin_counts(stream: DataFrame, spec: C.Coverage) -> DataFrame:
    """Running totals (chrom, lane, bin) of a stream of alignments with their chromosome's length: a streaming aggregate in update or complete mode."""
    if spec.fragments or spec.model == "extend" or spec.mask_mode == "fragments":
        raise ValueError("a stream counts single records; pairs are joined by mated() first")
    return C.bin_totals(C.units(stream, stream, spec), spec)


def mated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Forward and reverse mates of a stream with a column `arrived`, joined by name and place within the delay: (chrom, start, end) of each pair."""
    rows = stream.withColumn("end", A.aligned_end(F.col("pos"), F.col("cigar"))).withWatermark("arrived", delay)
    reverse = A.has(F.col("flag"), A.FLAGS["REVERSE"])
    left = rows.filter(~reverse).select("qname", F.col("chrom").alias("chrom"), F.col("pos").alias("start"), F.col("mpos").alias("to"), F.col("arrived").alias("a"))
    right = rows.filter(reverse).select(F.col("qname").alias("q"), F.col("chrom").alias("c"), F.col("pos").alias("at"), F.col("mpos").alias("from"), "end", F.col("arrived").alias("b"))
    near = (F.col("b") >= F.col("a") - F.expr(f"interval {delay}")) & (F.col("b") <= F.col("a") + F.expr(f"interval {delay}"))
    joined = left.join(right, (F.col("qname") == F.col("q")) & (F.col("chrom") == F.col("c")) & (F.col("to") == F.col("at")) & (F.col("from") == F.col("start")) & near)
    return joined.select("qname", "chrom", "start", "end")
