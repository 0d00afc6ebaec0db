"""Registry of the engine's own queries and of the SQL they are compared with."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import coverage as C
from tracklake.operators import intervals as I
from tracklake.operators import matrices as X
from tracklake.operators import matrix_build as B
from tracklake.operators import profiles as P
from tracklake.operators import tracks as T
from tracklake.plans import fixtures as f
from tracklake.sources import bigwig, text
from tracklake.sources.tables import shared_dir

FLAGSHIP = "coverage_read_count_rle"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def rounded(column: str, digits: int = 4):
    return F.round(F.col(column).cast("double"), digits)


# --- coverage -----------------------------------------------------------------------------------------------------------

BASE = {"exclude": 1024, "min_mapq": 10}
W, L = 50, f.LENGTH
#: Bins that blocks touch, with the overlap.
TOUCHED = f"touched AS (SELECT r, chrom, flag, b, least(e, {L}, (b + 1) * {W}) - greatest(s, b * {W}) AS o FROM blocks, LATERAL (SELECT unnest(range(s // {W}, (least(e, {L}) - 1) // {W} + 1)) AS b))"
COUNTED = "counted AS (SELECT chrom, b, count(DISTINCT r) AS c FROM touched GROUP BY ALL)"
READS = f"WITH {f.ALIGNMENTS_SQL}, {TOUCHED}, {COUNTED}"


def _bins(spark, sf, spec, df=None, **lists):
    rows = C.binned(f.alignments(spark, sf) if df is None else df, f.sizes(spark), spec, **lists)
    return rows.select("chrom", "strand", F.col("bin").cast("long").alias("bin"), rounded("value").alias("value"))


@query(
    f"""{READS}, dense AS (SELECT chrom, b, coalesce(c, 0) AS v FROM (SELECT 'chr' || i AS chrom FROM range(1, {f.CHROMS + 1}) t(i)) CROSS JOIN (SELECT b FROM range(0, {-(-L // W)}) u(b)) LEFT JOIN counted USING (chrom, b)),
marked AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM dense WINDOW w AS (PARTITION BY chrom ORDER BY b)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY b) AS run FROM marked)
SELECT chrom, CAST(min(b) * {W} AS BIGINT) AS "start", CAST(least((max(b) + 1) * {W}, {L}) AS BIGINT) AS "end", CAST(min(v) AS DOUBLE) AS value FROM runs GROUP BY chrom, run"""
)
def coverage_read_count_rle(spark, sf):
    runs = C.coverage(f.alignments(spark, sf), f.sizes(spark), C.Coverage(aggregation="count", **BASE))
    return runs.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("double").alias("value"))


@query(f"{READS} SELECT chrom, '.' AS strand, b AS bin, CAST(sum(o) AS DOUBLE) AS value FROM touched GROUP BY ALL")
def coverage_sum(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="sum", **BASE))


@query(f"{READS} SELECT chrom, '.' AS strand, b AS bin, round(CAST(CAST(t / (least((b + 1) * {W}, {L}) - b * {W}) AS FLOAT) AS DOUBLE), 4) AS value FROM (SELECT chrom, b, sum(o) AS t FROM touched GROUP BY ALL)")
def coverage_mean(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="mean", **BASE))


@query(f"{READS} SELECT chrom, '.' AS strand, b AS bin, round(CAST(CAST(c * (1e6 / (SELECT count(*) FROM reads)) AS FLOAT) AS DOUBLE), 4) AS value FROM counted")
def coverage_cpm(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", normalization="cpm", **BASE))


@query(f"{READS} SELECT chrom, '.' AS strand, b AS bin, round(CAST(CAST(c * (1e9 / (SELECT count(*) FROM kept) / (least((b + 1) * {W}, {L}) - b * {W})) AS FLOAT) AS DOUBLE), 1) AS value FROM counted")
def coverage_rpkm_filtered(spark, sf):
    rows = C.binned(f.alignments(spark, sf), f.sizes(spark), C.Coverage(aggregation="count", normalization="rpkm", denominator="filtered", **BASE))
    # Five figures before the point fill single precision, so one digit after it is compared.
    return rows.select("chrom", "strand", F.col("bin").cast("long").alias("bin"), rounded("value", 1).alias("value"))


@query(f"{READS} SELECT chrom, '.' AS strand, b AS bin, round(CAST(CAST(c * (1e6 / (SELECT sum(c) FROM counted WHERE chrom <> 'chr1')) AS FLOAT) AS DOUBLE), 4) AS value FROM counted")
def coverage_bpm_without_chromosome(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", normalization="bpm", ignored=("chr1",), **BASE))


@query(f"{READS}, {f.MASK_SQL}, hidden AS (SELECT DISTINCT chrom, unnest(range(s // {W}, (e - 1) // {W} + 1)) AS b FROM mask) SELECT chrom, '.' AS strand, b AS bin, CAST(c AS DOUBLE) AS value FROM counted ANTI JOIN hidden USING (chrom, b)")
def coverage_blacklist_bins(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", **BASE), blacklist=f.mask(spark, sf))


@query(
    f"""WITH {f.ALIGNMENTS_SQL}, {f.MASK_SQL}, hit AS (SELECT DISTINCT b.r FROM blocks b JOIN mask m ON b.chrom = m.chrom AND b.s < m.e AND m.s < b.e),
inside AS (SELECT r, chrom, least(e, {L}) AS e, s FROM blocks SEMI JOIN hit USING (r)), touched AS (SELECT r, chrom, unnest(range(s // {W}, (e - 1) // {W} + 1)) AS b FROM inside)
SELECT chrom, '.' AS strand, b AS bin, CAST(count(DISTINCT r) AS DOUBLE) AS value FROM touched GROUP BY ALL"""
)
def coverage_whitelist_fragments(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", mask_mode="fragments", **BASE), whitelist=f.mask(spark, sf))


@query(f"{READS} SELECT chrom, CASE WHEN flag & 16 = 0 THEN '-' ELSE '+' END AS strand, b AS bin, CAST(count(DISTINCT r) AS DOUBLE) AS value FROM touched GROUP BY ALL")
def coverage_split_strands(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", library="reverse", strand="split", **BASE))


@query(f"""WITH {f.ALIGNMENTS_SQL}, span AS (SELECT r, chrom, flag, min(s) AS s, max(e) AS e FROM blocks GROUP BY ALL) SELECT chrom, '.' AS strand, (CASE WHEN flag & 16 = 0 THEN s ELSE e - 1 END) // {W} AS bin, CAST(count(*) AS DOUBLE) AS value FROM span GROUP BY ALL""")
def coverage_five_prime_ends(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", model="5prime", **BASE))


@query(
    f"""WITH {f.ALIGNMENTS_SQL}, span AS (SELECT r, chrom, flag, min(s) AS s, max(e) AS e FROM blocks GROUP BY ALL),
grown AS (SELECT r, chrom, CASE WHEN flag & 16 = 0 THEN s ELSE greatest(e - greatest(150, e - s), 0) END AS s, CASE WHEN flag & 16 = 0 THEN least(s + greatest(150, e - s), {L}) ELSE e END AS e FROM span),
touched AS (SELECT chrom, unnest(range(s // {W}, (e - 1) // {W} + 1)) AS b FROM grown) SELECT chrom, '.' AS strand, b AS bin, CAST(count(*) AS DOUBLE) AS value FROM touched GROUP BY ALL"""
)
def coverage_extended_reads(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", model="extend", extend_length=150, **BASE))


@query(
    f"""WITH {f.PAIRS_SQL}, numbered AS (SELECT row_number() OVER () AS r, * FROM pairs),
blocks AS (SELECT r, chrom, v AS s, v + 50 AS e FROM numbered UNION ALL SELECT r, chrom, f, f + 50 FROM numbered WHERE NOT weak),
touched AS (SELECT r, chrom, unnest(range(s // {W}, (e - 1) // {W} + 1)) AS b FROM blocks) SELECT chrom, '.' AS strand, b AS bin, CAST(count(DISTINCT r) AS DOUBLE) AS value FROM touched GROUP BY ALL"""
)
def coverage_pairs_as_fragments(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", count_unit="fragment", min_mapq=10), f.pairs(spark, sf))


@query(
    f"""WITH {f.PAIRS_SQL}, spans AS (
SELECT chrom, f AS s, v + 50 AS e, CASE WHEN weak THEN 1 ELSE 2 END AS w FROM pairs WHERE d >= 0
UNION ALL SELECT chrom, f, f + 60, 1 FROM pairs WHERE d < 0 AND NOT weak UNION ALL SELECT chrom, greatest(v - 10, 0), v + 50, 1 FROM pairs WHERE d < 0),
touched AS (SELECT chrom, w, unnest(range(s // {W}, (e - 1) // {W} + 1)) AS b FROM spans) SELECT chrom, '.' AS strand, b AS bin, CAST(sum(w) AS DOUBLE) AS value FROM touched GROUP BY ALL"""
)
def coverage_extended_pairs(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", model="extend", extend_length=60, min_mapq=10), f.pairs(spark, sf))


@query(
    f"""WITH {f.PAIRS_SQL}, points AS (SELECT chrom, ((CASE WHEN weak AND d < 0 THEN v ELSE least(f, v) END) + (CASE WHEN weak AND d < 0 THEN v + 50 ELSE greatest(f, v) + 50 END)) // 2 AS p FROM pairs)
SELECT chrom, '.' AS strand, p // {W} AS bin, CAST(count(*) AS DOUBLE) AS value FROM points GROUP BY ALL"""
)
def coverage_fragment_centres(spark, sf):
    return _bins(spark, sf, C.Coverage(aggregation="count", model="center", count_unit="auto", min_mapq=10), f.pairs(spark, sf))


@query(f"WITH {f.ALIGNMENTS_SQL} SELECT chrom, count(*) AS mapped, CAST(0 AS BIGINT) AS unmapped FROM reads GROUP BY chrom")
def reads_per_chromosome(spark, sf):
    return C.reads_per_chromosome(f.alignments(spark, sf))


@query(
    f"""WITH {f.ALIGNMENTS_SQL}, {f.MASK_SQL}, spans AS (SELECT qname, chrom, flag, pos AS s, pos + q + CASE k WHEN 0 THEN 120 WHEN 1 THEN 10 ELSE 18 END AS e FROM reads WHERE flag & 256 = 0),
votes AS (SELECT qname, CASE WHEN (flag & 16 = 0) = (strand = '+') THEN 1 ELSE 0 END AS vote FROM spans p JOIN mask m ON p.chrom = m.chrom AND p.s < m.e AND m.s < p.e AND strand <> '.'),
one AS (SELECT qname, min(vote) AS low, max(vote) AS high FROM votes GROUP BY qname), n AS (SELECT count(*) FILTER (low = 1) AS forward, count(*) FILTER (low = 0) AS reverse FROM one WHERE low = high)
SELECT forward, reverse, round(forward / (forward + reverse), 6) AS share, CASE WHEN forward / (forward + reverse) >= 0.8 THEN 'forward' WHEN forward / (forward + reverse) <= 0.2 THEN 'reverse' ELSE 'none' END AS library FROM n"""
)
def library_strandedness(spark, sf):
    return C.strandedness(f.alignments(spark, sf), f.mask(spark, sf)).withColumn("share", F.round("share", 6))


# --- interval algebra ---------------------------------------------------------------------------------------------------

SPANS = f"{f.ALIGNMENTS_SQL}, spans AS (SELECT chrom, pos AS s, pos + q AS e FROM reads)"
MERGED = "{0}_marked AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS new FROM {1}), {0}_runs AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {0}_marked), {0} AS (SELECT chrom, min(s) AS s, max(e) AS e FROM {0}_runs GROUP BY chrom, run)"


def _spans(spark, sf):
    return f.alignments(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.aggregate(F.filter("cigar", lambda c: c["op"] == "M"), F.lit(0), lambda a, c: F.when(a > 0, a).otherwise(c["len"]))).alias("end"))


@query(f'WITH {SPANS}, {MERGED.format("merged", "spans")} SELECT chrom, s AS "start", e AS "end" FROM merged')
def intervals_merge(spark, sf):
    return I.merge(_spans(spark, sf))


#: Sets of bases, base by base, back to intervals.
BASEWISE = "{bases}, numbered AS (SELECT chrom, p, p - row_number() OVER (PARTITION BY chrom ORDER BY p) AS run FROM bases) SELECT chrom, min(p) AS \"start\", max(p) + 1 AS \"end\" FROM numbered GROUP BY chrom, run"
MASKED_BASES = "hidden AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS p FROM mask)"
SPAN_BASES = "shown AS (SELECT DISTINCT chrom, unnest(range(s, e)) AS p FROM spans)"


@query("WITH " + f"{SPANS}, {f.MASK_SQL}, {MASKED_BASES}, {SPAN_BASES}, " + BASEWISE.format(bases="bases AS (SELECT * FROM hidden ANTI JOIN shown USING (chrom, p))"))
def intervals_subtract(spark, sf):
    return I.subtract(f.mask(spark, sf), _spans(spark, sf))


@query("WITH " + f"{SPANS}, {f.MASK_SQL}, {MASKED_BASES}, {SPAN_BASES}, " + BASEWISE.format(bases="bases AS (SELECT * FROM hidden SEMI JOIN shown USING (chrom, p))"))
def intervals_intersect(spark, sf):
    return I.intersect(f.mask(spark, sf), _spans(spark, sf))


@query(f"WITH {SPANS}, {f.MASK_SQL} SELECT p.chrom, m.s AS mask_start, count(*) AS pairs, CAST(sum(least(p.e, m.e) - greatest(p.s, m.s)) AS BIGINT) AS bases FROM spans p JOIN mask m ON p.chrom = m.chrom AND p.s < m.e AND m.s < p.e GROUP BY ALL")
def intervals_overlap_join(spark, sf):
    hits = I.overlap_join(_spans(spark, sf), f.mask(spark, sf))
    return hits.groupBy("chrom", F.col("r_start").alias("mask_start")).agg(F.count("*").alias("pairs"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).cast("long").alias("bases"))


@query(f"WITH {f.REGIONS_SQL}, {f.MASK_SQL} SELECT row_id FROM regions r WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.chrom = r.chrom AND r.s * 10 < m.e AND m.s < r.s * 10 + n)")
def intervals_anti_overlap(spark, sf):
    rows = f.regions(spark, sf).select("row_id", "chrom", (F.col("blocks")[0]["start"] * 10).alias("start"), (F.col("blocks")[0]["start"] * 9 + F.col("blocks")[0]["end"]).alias("end"))
    return I.semi_overlap(rows, f.mask(spark, sf), anti=True).select("row_id")


# --- tracks -------------------------------------------------------------------------------------------------------------


@query(f"WITH {f.TRACKS_SQL} SELECT sample, CAST(count(*) * 10 AS BIGINT) AS bases, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM tracks GROUP BY sample")
def track_info(spark, sf):
    return T.info(f.tracks(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f'WITH {f.TRACKS_SQL} SELECT sample, chrom, s AS "start", e AS "end", round(CAST(CAST(value * 2.5 AS FLOAT) AS DOUBLE), 4) AS value FROM tracks')
def track_scale(spark, sf):
    return T.scale(f.tracks(spark, sf), 2.5).select("sample", "chrom", "start", "end", rounded("value").alias("value"))


@query(f'WITH {f.TRACKS_SQL} SELECT chrom, s // 25 * 25 + d * 25 AS "start", "start" + 25 AS "end", round(CAST(CAST(sum(value * (least(e, s // 25 * 25 + d * 25 + 25) - greatest(s, s // 25 * 25 + d * 25))) / 25 / 2 AS FLOAT) AS DOUBLE), 4) AS value FROM tracks, (VALUES (0), (1)) t(d) WHERE e > s // 25 * 25 + d * 25 GROUP BY ALL')
def track_merge_mean(spark, sf):
    return T.merge(f.tracks(spark, sf), f.sizes(spark), 25, "mean").select("chrom", "start", "end", rounded("value").alias("value"))


@query("SELECT name, chrom FROM (VALUES ('1', 'chr1'), ('chr2', 'chr2'), ('MT', 'chrM'), ('X', NULL)) t(name, chrom)")
def chromosome_aliases(spark, sf):
    names = spark.createDataFrame([("1",), ("chr2",), ("MT",), ("X",)], "name string")
    known = f.sizes(spark).select("chrom").union(spark.createDataFrame([("chrM",)], "chrom string"))
    return T.resolve_aliases(names, known)


# --- matrix build -------------------------------------------------------------------------------------------------------


def built_sql(zones: str, statistic: str, total: int, as_zero: bool = False, masked: bool = False, raw: bool = False) -> str:
    """Base by base: zones gives (row_id, chrom, minus, first, n, o, size, p) for each base of each zone. raw: values as they are."""
    value = "CASE WHEN hidden THEN NULL ELSE coalesce(t.value, 0) END" if as_zero else "CASE WHEN hidden THEN NULL ELSE t.value END"
    hidden = "EXISTS (SELECT 1 FROM mask m WHERE m.chrom = b.chrom AND b.p >= m.s AND b.p < m.e)" if masked else "false"
    reduce = {"mean": "avg(v)", "sum": "sum(v)", "max": "max(v)", "min": "min(v)", "median": "quantile_cont(v, 0.5)"}[statistic]
    shown = reduce if raw else f"round(CAST(CAST({reduce} AS FLOAT) AS DOUBLE), 4)"
    return f"""WITH {f.REGIONS_SQL}, {f.TRACKS_SQL}, {f.MASK_SQL}, {zones},
samples AS (SELECT unnest([0, 1]) AS sample), flagged AS (SELECT b.*, {hidden} AS hidden FROM bases b),
valued AS (SELECT b.row_id, b.minus, s.sample, b.first, b.n, b.o, b.size, {value} AS v FROM flagged b CROSS JOIN samples s LEFT JOIN tracks t ON t.sample = s.sample AND t.chrom = b.chrom AND t.s = b.p // 10 * 10 AND b.p >= 0),
cells AS (SELECT row_id, minus, sample, first + i AS bin, v FROM valued, LATERAL (SELECT unnest(range(o * n // size, o * n // size + n // size + 2)) AS i) WHERE i < n AND o >= i * size // n AND o < greatest(i * size // n + 1, (i + 1) * size // n))
SELECT row_id, sample, CAST(CASE WHEN minus THEN {total - 1} - bin ELSE bin END AS INT) AS bin, {shown} AS value FROM cells GROUP BY row_id, minus, sample, bin HAVING count(v) > 0"""


def _built(spark, sf, layout, **options):
    regions = f.regions(spark, sf)
    out = B.build(regions, f.tracks(spark, sf).select("source", "chrom", "start", "end", "value"), f.sizes(spark), layout, tracks_count=2, **options)
    return out.select("row_id", "sample", F.posexplode("bins").alias("bin", "value")).filter("value is not null").select("row_id", "sample", "bin", rounded("value").alias("value"))


FLANK = "SELECT row_id, chrom, minus, {first} AS first, {n} AS n, i AS o, {w} AS size, {start} + i AS p FROM bodies, LATERAL (SELECT unnest(range(0, {w})) AS i)"
#: Exon bases of a region with their offset from the left.
EXONIC = "exonic AS (SELECT b.row_id, b.chrom, b.minus, b.len, CASE WHEN i < b.n THEN b.s + i ELSE b.s + 15 + i END AS p, i AS o FROM bodies b, LATERAL (SELECT unnest(range(0, b.len)) AS i))"
TSS = f"""{EXONIC}, bases AS (
{FLANK.format(first=0, n=10, w=100, start="s - 100")} WHERE NOT minus
UNION ALL SELECT row_id, chrom, minus, 10, 20, i, 200, CASE WHEN i < len THEN (CASE WHEN i < n THEN s + i ELSE s + 15 + i END) ELSE e + i - len END FROM bodies, LATERAL (SELECT unnest(range(0, 200)) AS i) WHERE NOT minus
UNION ALL {FLANK.format(first=20, n=10, w=100, start="e")} WHERE minus
UNION ALL SELECT row_id, chrom, minus, 0, 20, 199 - i, 200, CASE WHEN i < len THEN (CASE WHEN len - 1 - i < n THEN s + len - 1 - i ELSE s + 15 + len - 1 - i END) ELSE s - 1 - (i - len) END FROM bodies, LATERAL (SELECT unnest(range(0, 200)) AS i) WHERE minus)"""
SCALED = f"""{EXONIC}, bases AS (
{FLANK.format(first=0, n="CASE WHEN minus THEN 2 ELSE 4 END", w="(CASE WHEN minus THEN 20 ELSE 40 END)", start="s - (CASE WHEN minus THEN 20 ELSE 40 END)")}
UNION ALL SELECT row_id, chrom, minus, CASE WHEN minus THEN 2 ELSE 4 END, 10, o, len, p FROM exonic
UNION ALL {FLANK.format(first="CASE WHEN minus THEN 12 ELSE 14 END", n="CASE WHEN minus THEN 4 ELSE 2 END", w="(CASE WHEN minus THEN 40 ELSE 20 END)", start="e")})"""


@query(built_sql(TSS, "mean", 30))
def matrix_tss_mean(spark, sf):
    return _built(spark, sf, B.Layout(upstream=100, downstream=200, bin_size=10), statistic="mean")


@query(f"""WITH base AS ({built_sql(TSS, "mean", 30, raw=True)}), {f.REGIONS_SQL},
valued AS (SELECT row_id, group_id, copy, bin, CASE WHEN strand = '.' THEN CASE WHEN count(*) = 2 THEN sum(value) END ELSE max(CASE WHEN sample = (CAST(strand = '-' AS INT) + copy) % 2 THEN value END) END AS v
  FROM base JOIN regions USING (row_id) CROSS JOIN (SELECT unnest([0, 1]) AS copy) GROUP BY row_id, group_id, strand, copy, bin)
SELECT row_id * 2 + copy AS row_id, CAST(group_id * 2 + copy AS INT) AS group_id, bin, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS value FROM valued WHERE v IS NOT NULL""")
def matrix_antisense_groups(spark, sf):
    """Two tracks as the strands of one sample; each region followed by its copy that reads the other strand."""
    regions = B.with_antisense_groups(f.regions(spark, sf))
    out = B.build(regions, f.tracks(spark, sf).select("source", "chrom", "start", "end", "value"), f.sizes(spark), B.Layout(upstream=100, downstream=200, bin_size=10), wanted=B.sources(regions, 1, stranded=True), tracks_count=2)
    return out.select("row_id", "group_id", F.posexplode("bins").alias("bin", "value")).filter("value is not null").select("row_id", "group_id", "bin", rounded("value").alias("value"))


@query(built_sql(SCALED, "median", 16, as_zero=True))
def matrix_scaled_median_zero_filled(spark, sf):
    return _built(spark, sf, B.Layout(upstream=40, downstream=20, body=100, bin_size=10), statistic="median", missing_as_zero=True)


@query(built_sql(SCALED, "sum", 16, masked=True))
def matrix_scaled_sum_masked(spark, sf):
    return _built(spark, sf, B.Layout(upstream=40, downstream=20, body=100, bin_size=10), statistic="sum", mask=f.mask(spark, sf))


@query(built_sql(TSS, "max", 30, as_zero=True, masked=True))
def matrix_tss_max_masked_zero_filled(spark, sf):
    return _built(spark, sf, B.Layout(upstream=100, downstream=200, bin_size=10), statistic="max", missing_as_zero=True, mask=f.mask(spark, sf))


# --- matrix algebra -----------------------------------------------------------------------------------------------------

CELLS = f"WITH {f.MATRIX_SQL}"
#: Each row and sample's statistics.
JUDGED = f"{CELLS}, judged AS (SELECT row_id, sample, count(v) AS n, min(v) AS low, max(v) AS high, avg(v) AS mean FROM cells GROUP BY ALL)"


def _cells(matrix: DataFrame, digits: int = 5) -> DataFrame:
    return matrix.select("row_id", "sample", F.posexplode("bins").alias("bin", "value")).select("row_id", "sample", "bin", rounded("value", digits).alias("value"))


@query(f"{JUDGED} SELECT DISTINCT row_id FROM judged WHERE row_id NOT IN (SELECT row_id FROM judged WHERE n > 0 AND (low < -0.3 OR high > 0.35))")
def filter_values_per_bin(spark, sf):
    return X.filter_values(f.matrix(spark, sf), -0.3, 0.35).select("row_id").distinct()


@query(f"{JUDGED} SELECT row_id, c.sample, c.bin, CASE WHEN c.sample IN (0, 2) AND n > 0 AND (mean < -0.02 OR mean > 0.03) THEN NULL ELSE round(v, 5) END AS value FROM cells c JOIN judged USING (row_id, sample)")
def filter_values_mean_mask_samples(spark, sf):
    return _cells(X.filter_values(f.matrix(spark, sf), -0.02, 0.03, "mean", samples=[0, 2], action="mask"))


@query(f"{JUDGED} SELECT DISTINCT row_id FROM judged WHERE row_id NOT IN (SELECT row_id FROM judged WHERE sample < 3 AND n < 16)")
def filter_missing_any_bin(spark, sf):
    return X.filter_values(f.matrix(spark, sf), nan_mode="any_bin", samples=[0, 1, 2]).select("row_id").distinct()


@query(f"{JUDGED} SELECT DISTINCT row_id FROM judged WHERE row_id NOT IN (SELECT row_id FROM judged WHERE n > 0 AND (low <= -0.25 OR high >= 0.3))")
def build_thresholds_inclusive(spark, sf):
    return X.threshold(f.matrix(spark, sf), -0.25, 0.3).select("row_id").distinct()


@query(f"{CELLS} SELECT row_id, CAST(o AS INT) AS sample, bin, round(v, 5) AS value FROM cells JOIN (VALUES (0, 3), (1, 0), (2, 3)) t(o, s) ON cells.sample = t.s")
def subset_and_reorder_samples(spark, sf):
    return _cells(X.subset_samples(f.matrix(spark, sf), [3, 0, 3]))


KEYS = f"{CELLS}, keyed AS (SELECT row_id, group_id, {{0}} AS key FROM cells {{1}} GROUP BY row_id, group_id)"


@query(f"{KEYS.format('max(v)', 'WHERE sample = 1')} SELECT row_id, group_id AS out_group, row_number() OVER (PARTITION BY group_id ORDER BY key DESC NULLS FIRST, row_id) - 1 AS out_pos FROM keyed")
def sort_within_groups_descending(spark, sf):
    return X.sort_order(f.matrix(spark, sf), "max", "descend", samples=[1])


@query(f"{KEYS.format('min(v)', '')}, ranked AS (SELECT row_id, row_number() OVER (ORDER BY key NULLS LAST, group_id, row_id) - 1 AS r, count(*) OVER () AS n FROM keyed), cut AS (SELECT *, (SELECT max(q) FROM range(0, 7) t(q) WHERE CAST(floor(q * n / 7) AS BIGINT) <= r) AS g FROM ranked) SELECT row_id, CAST(g AS INT) AS out_group, r - CAST(floor(g * n / 7) AS BIGINT) AS out_pos FROM cut")
def quantile_groups_of_sorted_rows(spark, sf):
    return X.sort_order(f.matrix(spark, sf), "min", "ascend", quantiles=7)


@query(f"WITH {f.REGIONS_SQL} SELECT row_id, CAST(group_id AS INT) AS out_group, row_number() OVER (PARTITION BY group_id ORDER BY score DESC NULLS LAST, row_id) - 1 AS out_pos FROM regions")
def sort_by_score(spark, sf):
    return X.sort_order(f.regions(spark, sf).withColumn("sample", F.lit(0)).withColumn("bins", F.array().cast("array<float>")), "score", "descend")


@query(f"WITH {f.REGIONS_SQL} SELECT row_id, CAST(group_id AS INT) AS out_group, row_number() OVER (PARTITION BY group_id ORDER BY n + CASE WHEN spliced THEN 30 ELSE 0 END, row_id) - 1 AS out_pos FROM regions")
def sort_by_region_length(spark, sf):
    return X.sort_order(f.regions(spark, sf), "region_length", "ascend")


@query(f"{CELLS}, parts AS (SELECT DISTINCT 0 AS m, row_id, group_id AS g FROM cells UNION ALL SELECT DISTINCT 1, row_id, CASE WHEN group_id < 5 THEN group_id ELSE group_id + 5 END FROM cells WHERE row_id % 3 = 0) SELECT m || ':' || row_id AS row_id, CAST(g AS INT) AS group_id, row_number() OVER (PARTITION BY g ORDER BY m, row_id) - 1 AS ord FROM parts")
def rbind_with_shared_groups(spark, sf):
    m = f.matrix(spark, sf)
    out, _ = X.rbind([(m, [f"g{i}" for i in range(10)]), (m.filter("row_id % 3 = 0"), [f"g{i}" if i < 5 else f"h{i}" for i in range(10)])])
    return out.select("row_id", "group_id", "ord").distinct()


@query(f"{CELLS} SELECT row_id, sample, bin, round(v, 5) AS value FROM cells UNION ALL SELECT row_id, sample + 4, bin, CASE WHEN row_id % 2 = 0 THEN round(v, 5) END FROM cells WHERE sample < 2")
def cbind_by_region(spark, sf):
    m = f.matrix(spark, sf)
    return _cells(X.cbind(m, m.filter("row_id % 2 = 0 and sample < 2"), ["group_id", "row_id"]))


@query(f"{CELLS} SELECT row_id, sample, bin, round(CAST(CAST(CASE WHEN CAST((f::DOUBLE * 3) AS FLOAT) + 0.5::DOUBLE > 0 THEN log2(CAST(CAST((f::DOUBLE * 3) AS FLOAT)::DOUBLE + 0.5 AS FLOAT)::DOUBLE) END AS FLOAT) AS DOUBLE), 4) AS value FROM cells")
def transform_scale_add_log(spark, sf):
    m = f.matrix(spark, sf)
    return _cells(m.withColumn("bins", X.log2(X.add(X.scale(F.col("bins"), 3.0), 0.5))), 4)


@query(f"{CELLS}, p AS (SELECT a.row_id, a.bin, a.v AS n, b.v AS d FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.bin = b.bin AND a.sample = 0 AND b.sample = 1) SELECT row_id, bin, round(CAST(CAST(CASE WHEN d + 1 <> 0 AND n + 1 <> 0 AND sign(n + 1) = sign(d + 1) THEN ln((n + 1) / (d + 1)) / ln(2.0) END AS FLOAT) AS DOUBLE), 4) AS value FROM p")
def compare_log2_fold_change(spark, sf):
    m = f.matrix(spark, sf)
    a, b = (m.filter(F.col("sample") == s).select("row_id", F.col("bins").alias(f"b{s}")) for s in (0, 1))
    out = a.join(b, "row_id").select("row_id", F.posexplode(X.compare(F.col("b0"), F.col("b1"), "log2_fold_change", 1.0)).alias("bin", "value"))
    return out.select("row_id", "bin", rounded("value").alias("value"))


@query(f"{CELLS}, pooled AS (SELECT row_id, sample, bin, v FROM cells UNION ALL SELECT row_id, 3 - sample, bin, v FROM cells) SELECT row_id, sample, bin, round(CAST(CAST(sum(v) / nullif(count(v), 0) AS FLOAT) AS DOUBLE), 5) AS value FROM pooled GROUP BY ALL")
def combine_mean_of_matrices(spark, sf):
    m = f.matrix(spark, sf)
    return _cells(X.combine([m, m.withColumn("sample", 3 - F.col("sample"))], "mean"))


@query(f"{CELLS}, d AS (SELECT row_id, sample, max(v) FILTER (bin >= 4 AND bin < 12) AS d FROM cells GROUP BY ALL) SELECT row_id, sample, bin, CASE WHEN d <> 0 THEN round(CAST(CAST(v / d AS FLOAT) AS DOUBLE), 3) END AS value FROM cells JOIN d USING (row_id, sample)")
def scale_rows_by_body_maximum(spark, sf):
    m = f.matrix(spark, sf)
    return _cells(m.withColumn("bins", X.scale_rows(F.col("bins"), "max", 4, 8)), 3)


@query(f"{CELLS} SELECT sample, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90 FROM cells GROUP BY sample")
def data_range(spark, sf):
    out = X.data_range(f.matrix(spark, sf))
    return out.select("sample", *[F.round(c, 6).alias(c) for c in ("min", "max", "median", "p10", "p90")])


@query(f"{CELLS} SELECT sample, round(min(v) FILTER (v <> 0), 6) AS value FROM cells GROUP BY sample")
def nonzero_minimum(spark, sf):
    return X.nonzero_extreme(f.matrix(spark, sf), "min").withColumn("value", F.round("value", 6))


# --- profiles -----------------------------------------------------------------------------------------------------------


def _profile(spark, sf, *args, **kwargs):
    out = P.profile(f.matrix(spark, sf), *args, **kwargs)
    return out.select("group_id", "sample", "bin", *[F.round(c, 6).alias(c) for c in ("centre", "lower", "upper")], "n")


PROFILE = f"{CELLS} SELECT group_id, sample, bin, {{0}} AS centre, {{1}} AS lower, {{2}} AS upper, count(v) AS n FROM cells GROUP BY ALL"
NONE = "CAST(NULL AS DOUBLE)"
SE = "stddev_pop(v) / sqrt(CASE WHEN count(v) > 1 THEN count(v) - 1 END)"


@query(PROFILE.format("round(avg(v), 6)", f"round(avg(v) - {SE}, 6)", f"round(avg(v) + {SE}, 6)"))
def profile_mean_with_standard_error(spark, sf):
    return _profile(spark, sf, "mean", "se")


@query(PROFILE.format("round(avg(v), 6)", "round(avg(v) - stddev_pop(v), 6)", "round(avg(v) + stddev_pop(v), 6)"))
def profile_mean_with_deviation(spark, sf):
    return _profile(spark, sf, "mean", "std")


@query(PROFILE.format("round(quantile_cont(v, 0.5), 6)", NONE, NONE))
def profile_median(spark, sf):
    return _profile(spark, sf, "median")


@query(PROFILE.format("round(sum(v), 6)", NONE, NONE))
def profile_sum(spark, sf):
    return _profile(spark, sf, "sum")


@query(f"{CELLS}, r AS (SELECT group_id, sample, bin, v, row_number() OVER (PARTITION BY group_id, sample, bin ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY group_id, sample, bin) AS n FROM cells WHERE v IS NOT NULL) SELECT group_id, sample, bin, round(avg(v) FILTER (k >= floor(n * 0.1) AND k < n - floor(n * 0.1)), 6) AS centre, {NONE} AS lower, {NONE} AS upper, max(n) AS n FROM r GROUP BY ALL")
def profile_trimmed_mean(spark, sf):
    return _profile(spark, sf, "trim_mean", trim=0.1)


@query(f"{CELLS}, a AS (SELECT group_id, sample, bin, abs(v) + 1 AS v FROM cells WHERE v IS NOT NULL), pc AS (SELECT group_id, sample, min(v) / 2 AS pc FROM a GROUP BY ALL) SELECT group_id, sample, bin, round(CASE WHEN min(v) = max(v) THEN min(v) ELSE max(pc) * (exp(avg(ln(1 + v / pc))) - 1) END, 6) AS centre, {NONE} AS lower, {NONE} AS upper, count(*) AS n FROM a JOIN pc USING (group_id, sample) GROUP BY ALL")
def profile_geometric_mean(spark, sf):
    m = f.matrix(spark, sf).withColumn("bins", F.transform("bins", lambda v: F.abs(v.cast("double")) + 1))
    out = P.profile(m, "geom_mean")
    return out.select("group_id", "sample", "bin", *[F.round(c, 6).alias(c) for c in ("centre", "lower", "upper")], "n")


@query(f"{CELLS} SELECT sample, round(quantile_cont(v, 0.01), 6) AS zmin, round(quantile_cont(v, 0.98), 6) AS zmax FROM cells GROUP BY sample")
def colour_limits(spark, sf):
    return P.colour_limits(f.matrix(spark, sf)).select("sample", F.round("zmin", 6).alias("zmin"), F.round("zmax", 6).alias("zmax"))


@query(f"{CELLS} SELECT row_id, sample, CAST(bin // 4 AS INT) AS bin, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 5) AS value FROM cells GROUP BY row_id, sample, bin // 4")
def raster_bin_down(spark, sf):
    return _cells(P.bin_down(f.matrix(spark, sf), 4))


@query()
def profile_mean_with_confidence(spark, sf):
    return _profile(spark, sf, "mean", "ci")


@query()
def profile_bootstrap(spark, sf):
    return P.bootstrap(f.matrix(spark, sf))


# --- more of the matrix build -------------------------------------------------------------------------------------------

#: Base of a region's blocks by its offset.
BASE_AT = "(CASE WHEN {0} < n THEN s + {0} ELSE s + 15 + {0} END)"
TES = f"""bases AS (
SELECT row_id, chrom, minus, 0 AS first, 10 AS n, 99 - i AS o, 100 AS size, CASE WHEN i < len THEN {BASE_AT.format("(len - 1 - i)")} ELSE s - 1 - (i - len) END AS p FROM bodies, LATERAL (SELECT unnest(range(0, 100)) AS i) WHERE NOT minus
UNION ALL {FLANK.format(first=10, n=20, w=200, start="e")} WHERE NOT minus
UNION ALL {FLANK.format(first=0, n=20, w=200, start="s - 200")} WHERE minus
UNION ALL SELECT row_id, chrom, minus, 20, 10, i, 100, CASE WHEN i < len THEN {BASE_AT.format("i")} ELSE e + i - len END FROM bodies, LATERAL (SELECT unnest(range(0, 100)) AS i) WHERE minus)"""
CENTRE = f"""sides AS (SELECT *, len // 2 AS middle, CASE WHEN minus THEN 200 ELSE 100 END AS l, CASE WHEN minus THEN 100 ELSE 200 END AS r FROM bodies), bases AS (
SELECT row_id, chrom, minus, 0 AS first, l // 10 AS n, l - 1 - i AS o, l AS size, CASE WHEN i < middle THEN {BASE_AT.format("(middle - 1 - i)")} ELSE s + middle - 1 - i END AS p FROM sides, LATERAL (SELECT unnest(range(0, l)) AS i)
UNION ALL SELECT row_id, chrom, minus, l // 10, r // 10, i, r, CASE WHEN middle + i < len THEN {BASE_AT.format("(middle + i)")} ELSE e + middle + i - len END FROM sides, LATERAL (SELECT unnest(range(0, r)) AS i))"""


@query(built_sql(TES, "min", 30))
def matrix_tes_min(spark, sf):
    return _built(spark, sf, B.Layout(upstream=100, downstream=200, bin_size=10, anchor="tes"), statistic="min")


@query(built_sql(CENTRE, "mean", 30, as_zero=True))
def matrix_centre_mean_zero_filled(spark, sf):
    return _built(spark, sf, B.Layout(upstream=100, downstream=200, bin_size=10, anchor="center"), statistic="mean", missing_as_zero=True)


@query(f"WITH {f.REGIONS_SQL}, {f.MASK_SQL}, {TSS} SELECT DISTINCT row_id FROM bases WHERE row_id NOT IN (SELECT b.row_id FROM bases b JOIN mask m ON m.chrom = b.chrom AND b.p >= m.s AND b.p < m.e)")
def matrix_hard_mask(spark, sf):
    out = B.build(f.regions(spark, sf), f.tracks(spark, sf).select("source", "chrom", "start", "end", "value"), f.sizes(spark), B.Layout(upstream=100, downstream=200, bin_size=10), tracks_count=2, mask=f.mask(spark, sf), hard_mask=True)
    return out.select("row_id").distinct()


# --- more algebra -------------------------------------------------------------------------------------------------------


@query(f"WITH {f.REGIONS_SQL} SELECT row_id, strand FROM regions WHERE strand <> '.'")
def filter_strand(spark, sf):
    return X.filter_strand(f.regions(spark, sf), ["+", "-"]).select("row_id", "strand")


@query(f"{CELLS} SELECT row_id FROM cells GROUP BY row_id HAVING max(abs(v)) >= 0.33")
def skip_rows_without_signal(spark, sf):
    m = f.matrix(spark, sf)
    return X.skip_zeros(m.withColumn("bins", F.transform("bins", lambda v: F.when(F.abs(v) >= 0.33, v).otherwise(F.lit(0).cast("float"))))).select("row_id").distinct()


@query(f"{CELLS}, gone AS (SELECT row_id FROM cells WHERE sample IN (1, 2) GROUP BY row_id HAVING count(CASE WHEN abs(v) >= 0.2 THEN v END) = 0) SELECT DISTINCT row_id FROM cells WHERE row_id NOT IN (SELECT row_id FROM gone)")
def filter_missing_all_bins(spark, sf):
    m = f.matrix(spark, sf)
    return X.filter_values(m.withColumn("bins", F.transform("bins", lambda v: F.when(F.abs(v) >= 0.2, v))), nan_mode="all_bins", samples=[1, 2]).select("row_id").distinct()


@query(f"{CELLS} SELECT DISTINCT row_id, CAST(CASE group_id WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT) AS group_id FROM cells WHERE group_id IN (7, 2, 4)")
def subset_and_reorder_groups(spark, sf):
    return X.subset_groups(f.matrix(spark, sf), [7, 2, 4]).select("row_id", "group_id").distinct()


@query(f"{CELLS} SELECT DISTINCT row_id, CAST(group_id % 3 AS INT) AS group_id FROM cells")
def merge_groups_of_one_name(spark, sf):
    _, mapping = X.merge_groups([f"g{i % 3}" for i in range(10)])
    return X.map_groups(f.matrix(spark, sf), mapping).select("row_id", "group_id").distinct()


@query(f"{CELLS}, held AS (SELECT DISTINCT row_id, group_id FROM cells WHERE group_id % 2 = 1), numbered AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS g FROM (SELECT DISTINCT group_id FROM held)) SELECT row_id, CAST(g AS INT) AS group_id FROM held JOIN numbered USING (group_id)")
def drop_groups_without_rows(spark, sf):
    _, rows = X.drop_empty_groups([f"g{i}" for i in range(10)], f.matrix(spark, sf).filter("group_id % 2 = 1"))
    return rows.select("row_id", "group_id").distinct()


@query("SELECT p_partkey AS row_id, CAST(p_partkey % 2 AS INT) AS out_group, row_number() OVER (PARTITION BY p_partkey % 2 ORDER BY -p_partkey) - 1 AS out_pos FROM part WHERE p_partkey % 5 <> 0")
def restore_order_of_a_list(spark, sf):
    rows = f.regions(spark, sf).withColumn("name", F.concat(F.lit("n"), F.col("row_id").cast("string"))).withColumn("sample", F.lit(0))
    listed = rows.filter("row_id % 5 <> 0").select("group_id", "name", (-F.col("row_id")).alias("bed_ord"))
    return X.restore_order(rows, listed)


@query(f"WITH {f.REGIONS_SQL}, placed AS (SELECT row_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY score, row_id) - 1 AS pos, count(*) OVER (PARTITION BY group_id) AS n FROM regions) SELECT row_id, CAST(group_id AS INT) AS out_group, pos AS out_pos, n - 1 - pos AS draw_pos FROM placed")
def draw_positions_from_the_bottom(spark, sf):
    rows = f.regions(spark, sf).withColumn("sample", F.lit(0)).withColumn("bins", F.array().cast("array<float>"))
    return X.draw_positions(X.sort_order(rows, "score", "ascend"))


@query(f"{CELLS}, p AS (SELECT a.row_id, a.bin, CASE WHEN abs(a.v) < 0.1 THEN 0 ELSE a.v END AS n, CASE WHEN abs(b.v) < 0.1 THEN 0 ELSE b.v END AS d FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.bin = b.bin AND a.sample = 2 AND b.sample = 3) SELECT row_id, bin, CASE WHEN n <> 0 AND d <> 0 THEN round(CAST(CAST((n + 1) / (d + 1) AS FLOAT) AS DOUBLE), 4) END AS value FROM p")
def compare_ratio_without_zeros(spark, sf):
    m = f.matrix(spark, sf).withColumn("bins", F.transform("bins", lambda v: F.when(v.isNotNull(), F.when(F.abs(v) < 0.1, F.lit(0).cast("float")).otherwise(v))))
    a, b = (m.filter(F.col("sample") == s).select("row_id", F.col("bins").alias(f"b{s}")) for s in (2, 3))
    out = a.join(b, "row_id").select("row_id", F.posexplode(X.compare(F.col("b2"), F.col("b3"), "ratio", 1.0, "any")).alias("bin", "value"))
    return out.select("row_id", "bin", rounded("value").alias("value"))


@query(f"{CELLS}, p AS (SELECT a.row_id, a.bin, a.v AS n, b.v AS d FROM cells a JOIN cells b ON a.row_id = b.row_id AND a.bin = b.bin AND a.sample = 0 AND b.sample = 2) SELECT row_id, bin, round(CAST(CAST(n - d AS FLOAT) AS DOUBLE), 5) AS value FROM p")
def compare_difference(spark, sf):
    m = f.matrix(spark, sf)
    a, b = (m.filter(F.col("sample") == s).select("row_id", F.col("bins").alias(f"b{s}")) for s in (0, 2))
    out = a.join(b, "row_id").select("row_id", F.posexplode(X.compare(F.col("b0"), F.col("b2"), "difference")).alias("bin", "value"))
    return out.select("row_id", "bin", rounded("value", 5).alias("value"))


@query(f"{CELLS}, t AS (SELECT row_id, sample, string_agg(CASE WHEN v IS NULL THEN 'nan' ELSE printf('%.6f', v) END, chr(9) ORDER BY bin) AS t FROM cells GROUP BY ALL) SELECT row_id, string_agg(t, chr(9) ORDER BY sample) AS line FROM t GROUP BY row_id")
def matrix_text(spark, sf):
    meta = {"chrom": F.lit("c"), "blocks": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))), "name": F.col("row_id").cast("string"), "score": F.lit(None).cast("double"), "strand": F.lit(".")}
    lines = text.matrix_lines(f.matrix(spark, sf).withColumns(meta))
    return lines.select(F.col("ord").alias("row_id"), F.array_join(F.slice(F.split("line", "\t"), 7, 1 << 20), "\t").alias("line"))


# --- more intervals and tracks ------------------------------------------------------------------------------------------


@query(f"WITH {SPANS} SELECT chrom, greatest(s - 300, 0) AS \"start\", least(e + 700, 99000) AS \"end\" FROM spans WHERE greatest(s - 300, 0) < 99000")
def intervals_clip(spark, sf):
    rows = _spans(spark, sf).select("chrom", (F.col("start") - 300).alias("start"), (F.col("end") + 700).alias("end"))
    return I.clip(rows, f.sizes(spark).withColumn("length", F.lit(99000).cast("long"))).select("chrom", "start", "end")


@query("SELECT chrom, CAST(100 AS BIGINT) AS length FROM (VALUES ('a'), ('c')) t(chrom)")
def chromosomes_common_to_tracks(spark, sf):
    return T.common_sizes(spark.createDataFrame([(0, "a", 100), (0, "b", 100), (0, "c", 100), (1, "a", 100), (1, "b", 90), (1, "c", 100), (1, "d", 5)], "sample int, chrom string, length long"))


@query(f"WITH {f.PAIRS_SQL} SELECT quantile_cont(d + 50, 0.5) AS fragment_length FROM pairs WHERE d >= 0")
def typical_fragment_length(spark, sf):
    return C.typical_fragment(f.pairs(spark, sf), sample=1 << 30)


# --- more summaries -----------------------------------------------------------------------------------------------------


@query(f"{CELLS}, p AS (SELECT group_id, sample, bin, avg(v) AS m FROM cells GROUP BY ALL) SELECT sample, round(min(m), 6) AS ymin, round(max(m), 6) AS ymax FROM p GROUP BY sample")
def axis_limits_of_profiles(spark, sf):
    out = P.y_limits(P.profile(f.matrix(spark, sf)), ["sample"])
    return out.select("sample", F.round("ymin", 6).alias("ymin"), F.round("ymax", 6).alias("ymax"))


@query(f"{CELLS} SELECT group_id, sample, round(quantile_cont(v, 0.01), 6) AS zmin, round(quantile_cont(v, 0.98), 6) AS zmax FROM cells GROUP BY ALL")
def colour_limits_by_panel(spark, sf):
    return P.colour_limits(f.matrix(spark, sf), "panel").select("group_id", "sample", F.round("zmin", 6).alias("zmin"), F.round("zmax", 6).alias("zmax"))


@query(f"{CELLS} SELECT sample, round(quantile_cont(v, 0.37), 6) AS value FROM cells GROUP BY sample")
def quantile_of_all_cells(spark, sf):
    return P.cell_quantile(f.matrix(spark, sf), 0.37).withColumn("value", F.round("value", 6))


@query(
    f"""{CELLS}, x AS (SELECT row_id, group_id, list(coalesce(v, 0) ORDER BY sample, bin) AS x FROM cells GROUP BY ALL),
d AS (SELECT a.row_id, a.group_id AS g, b.group_id AS h, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM x a JOIN x b ON true GROUP BY ALL),
s AS (SELECT row_id, g, max(CASE WHEN g = h THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN g <> h THEN t / n END) AS b FROM d GROUP BY ALL)
SELECT row_id, CAST(g AS INT) AS cluster, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 5) AS silhouette FROM s"""
)
def silhouettes_of_groups(spark, sf):
    from tracklake.operators import clusters

    m = f.matrix(spark, sf)
    rows = clusters.row_vectors(m).join(m.select("row_id", F.col("group_id").alias("cluster")).distinct(), "row_id")
    return clusters.silhouettes(rows).withColumn("silhouette", F.round("silhouette", 5))


@query()
def clusters_by_kmeans(spark, sf):
    from tracklake.operators import clusters

    return clusters.kmeans(clusters.row_vectors(f.matrix(spark, sf)), 4).select("row_id", "cluster", "name")


@query()
def clusters_by_ward(spark, sf):
    from tracklake.operators import clusters

    return clusters.ward(clusters.row_vectors(f.matrix(spark, sf)), 4).select("row_id", "cluster", "name")


# --- files: written to the shared folder and read again -------------------------------------------------------------------


def _place(spark, name):
    return f"{shared_dir(spark)}/tracklake/{name}-{uuid.uuid4().hex}"


def _lines(df, path):
    """A text file of one part, in order: the formats that are read line by line are lists."""
    df.coalesce(1).sortWithinPartitions("ord").select("line").write.text(path)
    return path


ONE_TRACK = f"WITH {f.TRACKS_SQL} SELECT chrom, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM tracks WHERE sample = 1"


def _one_track(spark, sf):
    return f.tracks(spark, sf).filter("sample = 1").select("chrom", "start", "end", F.col("value").cast("float").alias("value"))


def _shown(track):
    return track.select("chrom", "start", "end", rounded("value").alias("value"))


@query(ONE_TRACK)
def file_bedgraph(spark, sf):
    path = _place(spark, "track")
    text.write_bedgraph(_one_track(spark, sf), f.sizes(spark), path)
    return _shown(text.read_bedgraph(spark, path))


@query(ONE_TRACK)
def file_bigwig(spark, sf):
    """A bigWig file is assembled by the driver, so it is a path of the driver's file system that executors see too."""
    path = _place(spark, "track").removeprefix("file://") + ".bw"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    bigwig.write_bigwig(_one_track(spark, sf), f.sizes(spark), path)
    return _shown(bigwig.read_bigwig(spark, path))


@query(f"WITH {f.TRACKS_SQL} SELECT 'chr' || i AS chrom, CAST({f.LENGTH} AS BIGINT) AS length, count(t.s) AS intervals FROM range(1, {f.CHROMS + 1}) r(i) LEFT JOIN tracks t ON t.chrom = 'chr' || i AND t.sample = 1 GROUP BY i")
def file_bigwig_chromosomes(spark, sf):
    path = _place(spark, "track").removeprefix("file://") + ".bw"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    bigwig.write_bigwig(_one_track(spark, sf), f.sizes(spark), path)
    held = bigwig.read_bigwig(spark, path).groupBy("chrom").agg(F.count("*").alias("n"))
    return bigwig.chrom_sizes(spark, path).join(held, "chrom", "left").select("chrom", F.col("length").cast("long").alias("length"), F.coalesce("n", F.lit(0)).alias("intervals"))


LISTED = f"WITH {f.REGIONS_SQL}, blocks AS (SELECT row_id, count(*) AS blocks, CAST(sum(e - s) AS BIGINT) AS bases, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS \"end\" FROM exons GROUP BY row_id)"


def _listed(regions):
    size = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["end"] - b["start"])
    return regions.select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("row_id"), "chrom", "strand", F.size("blocks").cast("long").alias("blocks"), size.alias("bases"), F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"))


def _written_regions(spark, sf):
    rows = f.regions(spark, sf)
    return rows.withColumn("start", F.col("blocks")[0]["start"]).withColumn("end", F.element_at("blocks", -1)["end"]).withColumn("name", F.concat(F.lit("r"), F.col("row_id").cast("string")))


@query(f"{LISTED} SELECT row_id, chrom, strand, blocks, bases, start, \"end\" FROM regions JOIN blocks USING (row_id)")
def file_bed12(spark, sf):
    rows = _written_regions(spark, sf)
    listed = lambda of: F.array_join(F.transform("blocks", lambda b: of(b).cast("string")), ",")
    line = F.concat_ws("\t", "chrom", "start", "end", "name", F.lit("0"), "strand", "start", "end", F.lit("0"), F.size("blocks"), listed(lambda b: b["end"] - b["start"]), listed(lambda b: b["start"] - F.col("start")))
    return _listed(text.read_bed(spark, _lines(rows.select("ord", line.alias("line")), _place(spark, "bed"))))


@query(f"{LISTED} SELECT row_id, chrom, strand, blocks, bases, start, \"end\", 'g' || group_id AS \"group\" FROM regions JOIN blocks USING (row_id)")
def file_gtf_exons(spark, sf):
    rows = _written_regions(spark, sf)
    whole = F.struct(F.lit("transcript").alias("kind"), F.col("start").alias("s"), F.col("end").alias("e"))
    parts = F.transform("blocks", lambda b: F.struct(F.lit("exon").alias("kind"), b["start"].alias("s"), b["end"].alias("e")))
    rows = rows.select("ord", "chrom", "strand", "name", "group_id", F.explode(F.concat(F.array(whole), parts)).alias("x"))
    mark = F.format_string('gene_id "x"; transcript_id "%s"; kind "g%d";', "name", "group_id")
    line = F.concat_ws("\t", "chrom", F.lit("t"), "x.kind", (F.col("x.s") + 1).cast("string"), F.col("x.e").cast("string"), F.lit("."), "strand", F.lit("."), mark)
    found = text.read_gtf(spark, _lines(rows.select("ord", line.alias("line")), _place(spark, "gtf")), keep_exons=True, group_attribute="kind")
    groups = found.select(F.regexp_extract("name", r"\d+", 0).cast("long").alias("row_id"), "group")
    return _listed(found).join(groups, "row_id")


@query(f"WITH {f.ALIGNMENTS_SQL}, {TOUCHED}, {COUNTED} SELECT chrom, '.' AS strand, CAST(b AS BIGINT) AS bin, CAST(c AS DOUBLE) AS value FROM counted")
def file_sam_coverage(spark, sf):
    rows = f.alignments(spark, sf)
    cigar = F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    line = F.concat_ws("\t", "qname", "flag", "chrom", (F.col("pos") + 1).cast("string"), "mapq", cigar, F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"))
    head = f.sizes(spark).select(F.format_string("@SQ\tSN:%s\tLN:%d", "chrom", "length").alias("line"))
    path = _place(spark, "sam")
    head.unionByName(rows.select(line.alias("line"))).write.text(path)
    reads, sizes = text.read_sam(spark, path)
    spec = C.Coverage(bin_size=W, aggregation="count", **BASE)
    return C.binned(reads, sizes, spec).select("chrom", "strand", F.col("bin").cast("long").alias("bin"), rounded("value").alias("value"))


@query(f"{CELLS} SELECT row_id, sample, bin, CASE WHEN v IS NOT NULL THEN round(CAST(CAST(round(v, 6) AS FLOAT) AS DOUBLE), 5) END AS value FROM cells")
def file_matrix(spark, sf):
    meta = {"chrom": F.lit("c"), "blocks": F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("end"))), "name": F.concat(F.lit("r"), F.col("row_id").cast("string")), "score": F.lit(None).cast("double"), "strand": F.lit(".")}
    matrix = f.matrix(spark, sf).withColumns(meta)
    names = [f"g{g}" for g in range((matrix.agg(F.max("group_id")).first()[0] or 0) + 1)]
    path = _place(spark, "matrix")
    text.write_matrix(text.matrix_header({}, matrix, names, ["a", "b", "c", "d"]), matrix, path)
    _, again = text.read_matrix(spark, _joined(spark, path))
    return _cells(again.withColumn("row_id", F.regexp_extract("name", r"\d+", 0).cast("long")))


def _joined(spark, path):
    """The parts of a text folder, which are in order, as a folder of one part."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.input_file_name().alias("part"), F.col("value").alias("line"))
    order = rows.withColumn("ord", F.row_number().over(Window.orderBy("part", "ord")))
    return _lines(order, f"{path}-whole")
