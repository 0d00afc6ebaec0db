"""The engine's inputs read off the driver's tables, and the same inputs as SQL for comparison.

lineitem stands for alignments (once as single reads, once as pairs) and for two tracks, part for regions, supplier for
masked intervals, embeddings for a stored matrix of four samples of 16 bins with small values missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.sources.tables import read_table

CHROMS, LENGTH = 5, 99_990


table = read_table


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"chr{i + 1}", i, LENGTH) for i in range(CHROMS)], "chrom string, ord int, length long")


def _op(n, op: str):
    return F.struct(F.lit(op).alias("op"), (n if not isinstance(n, int) else F.lit(n)).cast("int").alias("len"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single reads: spliced, clipped or with a deletion by line number."""
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 3
    cigar = F.when(k == 0, F.array(_op(q, "M"), _op(100, "N"), _op(20, "M"))).when(k == 1, F.array(_op(5, "S"), _op(q, "M"), _op(2, "I"), _op(10, "M"))).otherwise(F.array(_op(q, "M"), _op(3, "D"), _op(15, "M")))
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(F.col("l_linenumber") == 7, 256).otherwise(0) + F.when((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "F"), 1024).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), F.lit(None).cast("string").alias("rg"), flag.cast("int").alias("flag"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % CHROMS + 1).cast("string")).alias("chrom"), ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11 + F.col("l_linenumber") * 101) % 99000).alias("pos"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 60).cast("int").alias("mapq"), cigar.alias("cigar"), F.lit(None).cast("string").alias("mchrom"), F.lit(-1).cast("long").alias("mpos"), F.lit(0).cast("long").alias("tlen"),
    )


ALIGNMENTS_SQL = f"""
reads AS (SELECT 'chr' || (l_suppkey % {CHROMS} + 1) AS chrom, (l_partkey * 37 + l_orderkey * 11 + l_linenumber * 101) % 99000 AS pos, CAST(l_quantity AS INT) AS q, l_linenumber % 3 AS k,
  l_orderkey || '-' || l_linenumber AS qname,
  (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END) + (CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END) + (CASE WHEN l_linenumber = 6 AND l_linestatus = 'F' THEN 1024 ELSE 0 END) AS flag,
  (l_orderkey * 7 + l_linenumber) % 60 AS mapq, row_number() OVER () AS r FROM lineitem),
kept AS (SELECT * FROM reads WHERE flag & 256 = 0 AND flag & 1024 = 0 AND mapq >= 10),
blocks AS (
  SELECT r, chrom, flag, pos AS s, pos + q + CASE WHEN k = 1 THEN 10 ELSE 0 END AS e FROM kept
  UNION ALL SELECT r, chrom, flag, pos + q + 100, pos + q + 120 FROM kept WHERE k = 0
  UNION ALL SELECT r, chrom, flag, pos + q + 3, pos + q + 18 FROM kept WHERE k = 2)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two mates for each line: inward or dovetailed, some below the quality that the queries ask; repeated lines are ambiguous mates."""
    base = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), F.concat(F.lit("chr"), (F.col("l_suppkey") % CHROMS + 1).cast("string")).alias("chrom"),
        ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 98000).alias("f"), (F.col("l_quantity").cast("long") * 4 - 20).alias("d"), (F.col("l_orderkey") % 5 == 0).alias("weak"),
    )
    ends = base.withColumn("v", F.col("f") + F.col("d")).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    own, other, first = F.when(F.col("m") == 0, F.col("f")).otherwise(F.col("v")), F.when(F.col("m") == 0, F.col("v")).otherwise(F.col("f")), F.col("m") == 0
    return ends.filter("v >= 0").select(
        "qname", F.lit(None).cast("string").alias("rg"), F.when(first, 99).otherwise(147).alias("flag"), "chrom", own.alias("pos"), F.when(F.col("weak") & first, 0).otherwise(60).alias("mapq"),
        F.array(_op(50, "M")).alias("cigar"), F.col("chrom").alias("mchrom"), other.alias("mpos"), F.when(first, F.col("d") + 50).otherwise(-F.col("d") - 50).cast("long").alias("tlen"),
    )


#: One row for each distinct pair, with its multiplicity: repeated mates agree, so they count as one mate.
PAIRS_SQL = f"""
lines AS (SELECT l_orderkey || '-' || l_linenumber AS qname, 'chr' || (l_suppkey % {CHROMS} + 1) AS chrom, (l_partkey * 37 + l_orderkey * 11) % 98000 AS f, CAST(l_quantity AS BIGINT) * 4 - 20 AS d, l_orderkey % 5 = 0 AS weak FROM lineitem),
pairs AS (SELECT *, f + d AS v FROM lines WHERE f + d >= 0)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of disjoint ten-base intervals."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linestatus") == "O").cast("int").alias("sample"), F.concat(F.lit("chr"), (F.col("l_suppkey") % CHROMS + 1).cast("string")).alias("chrom"), ((F.col("l_partkey") % 1000) * 10).alias("start"))
    return rows.agg(F.sum("l_quantity").alias("value")).withColumn("end", F.col("start") + 10).withColumn("source", F.col("sample"))


TRACKS_SQL = f"""
tracks AS (SELECT CAST(l_linestatus = 'O' AS INT) AS sample, 'chr' || (l_suppkey % {CHROMS} + 1) AS chrom, (l_partkey % 1000) * 10 AS s, (l_partkey % 1000) * 10 + 10 AS e, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each part: one block, or two with a gap of 15 bases; strand by key."""
    start, n = (F.col("p_partkey") * 53) % 9000 + 200, F.col("p_size") * 4 + 30
    one = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    blocks = F.when(F.col("p_partkey") % 4 == 0, F.array(one(start, start + n), one(start + n + 15, start + n + 45))).otherwise(F.array(one(start, start + n)))
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 2).cast("int").alias("group_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("chr"), (F.col("p_partkey") % CHROMS + 1).cast("string")).alias("chrom"),
        blocks.alias("blocks"), F.col("p_name").alias("name"), strand.alias("strand"), F.col("p_retailprice").alias("score"),
    )


REGIONS_SQL = f"""
regions AS (SELECT p_partkey AS row_id, p_partkey % 2 AS group_id, 'chr' || (p_partkey % {CHROMS} + 1) AS chrom, (p_partkey * 53) % 9000 + 200 AS s, p_size * 4 + 30 AS n, p_partkey % 4 = 0 AS spliced, ['+', '-', '.'][p_partkey % 3 + 1] AS strand, p_retailprice AS score FROM part),
exons AS (SELECT row_id, s, s + n AS e FROM regions UNION ALL SELECT row_id, s + n + 15, s + n + 45 FROM regions WHERE spliced),
bodies AS (SELECT r.*, s + n + CASE WHEN spliced THEN 45 ELSE 0 END AS e, n + CASE WHEN spliced THEN 30 ELSE 0 END AS len, strand = '-' AS minus FROM regions r)"""


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short interval for each supplier."""
    start = (F.col("s_suppkey") * 7919) % 90000
    strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), (F.col("s_suppkey") % CHROMS + 1).cast("string")).alias("chrom"), start.alias("start"), (start + 40 + F.col("s_nationkey") * 20).cast("long").alias("end"), strand.alias("strand"))


MASK_SQL = f"""
mask AS (SELECT 'chr' || (s_suppkey % {CHROMS} + 1) AS chrom, (s_suppkey * 7919) % 90000 AS s, (s_suppkey * 7919) % 90000 + 40 + s_nationkey * 20 AS e, ['+', '-', '.'][s_nationkey % 3 + 1] AS strand FROM supplier)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored matrix: groups by label, four samples of 16 bins, values under 0.01 missing."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("group_id"), F.col("vec_id").alias("ord"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.slice("embedding", s * 16 + 1, F.lit(16)))).alias("sample", "raw"))
    return rows.select("row_id", "group_id", "ord", "sample", F.transform("raw", lambda v: F.when(F.abs(v) >= 0.01, v.cast("float"))).alias("bins"))


MATRIX_SQL = """
cells AS (SELECT vec_id AS row_id, label AS group_id, CAST((i - 1) // 16 AS INT) AS sample, CAST((i - 1) % 16 AS INT) AS bin, CASE WHEN abs(embedding[i]) >= 0.01 THEN CAST(embedding[i] AS FLOAT) END AS f, CAST(f AS DOUBLE) AS v
  FROM embeddings, generate_series(1, 64) g(i))"""
