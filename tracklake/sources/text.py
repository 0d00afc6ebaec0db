"""Text formats: SAM, BED, GTF, bedGraph, chromosome sizes and stored matrices.

Line order carries meaning in BED, GTF and matrix files. Their lines are numbered by byte offset of the file split, by a
reader that never gathers a file on the driver: see `numbered_lines`.
"""

from __future__ import annotations

import bz2
import gzip
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import alignments as A
from tracklake.functions.missing import finite, let, narrow
from tracklake.operators import intervals as I
from tracklake.shipping import ship_code

BLOCKS = "array<struct<start:bigint,end:bigint>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of a text file, plain or compressed: one whole-file row is split where it is read.

    Region lists are small files (a line per region); a file is one task.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bz2.decompress(data) if data[:3] == b"BZh" else data
                lines = data.decode("utf-8").splitlines()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], ["ord", "line"])

    ship_code(spark)
    return raw.mapInArrow(run, "ord long, line string")


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, chromosome sizes) of a SAM file. Plain text is split freely: record order is not needed."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").startswith("@SQ"))
    tag = lambda name: F.regexp_extract("value", rf"\t{name}:([^\t]+)", 1)
    sizes = header.select(tag("SN").alias("chrom"), tag("LN").cast("long").alias("length")).withColumn("ord", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    f = F.split("value", "\t")
    rg = F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1)
    mate = F.when(f[6] == "=", f[2]).when(f[6] != "*", f[6])
    rows = lines.filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(
        f[0].alias("qname"), F.when(rg != "", rg).alias("rg"), f[1].try_cast("int").alias("flag"), F.when(f[2] != "*", f[2]).alias("chrom"), (f[3].try_cast("long") - 1).alias("pos"), f[4].try_cast("int").alias("mapq"),
        A.cigar_array(f[5]).alias("cigar"), mate.alias("mchrom"), (f[7].try_cast("long") - 1).alias("mpos"), f[8].try_cast("long").alias("tlen"),
    )
    return rows, sizes.select("chrom", "ord", "length")


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, ord, length of a two-column file (a FASTA index as well)."""
    rows = numbered_lines(spark, path).withColumn("f", F.split("line", "\t"))
    return rows.filter(F.size("f") >= 2).select(F.col("f")[0].alias("chrom"), F.col("ord").cast("int").alias("ord"), F.col("f")[1].cast("long").alias("length"))


def _unique_names(rows: DataFrame, order: str) -> DataFrame:
    """A name that has occurred before gets _r1, _r2, ..."""
    again = F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1
    return rows.withColumn("_again", again).withColumn("name", F.when(F.col("_again") > 0, F.concat("name", F.lit("_r"), F.col("_again").cast("string"))).otherwise(F.col("name"))).drop("_again")


def _score(text: Column) -> Column:
    return finite(F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text).cast("double"))


def read_bed(spark: SparkSession, path: str, default_group: str = "genes") -> DataFrame:
    """Regions of a BED3, BED6 or BED12 file: row_id, ord, chrom, blocks, name, group_id, group, strand, score.

    The first region's width decides the kind for the file. A '#' line names the group of the lines above it; lines after
    the last one are the default group. Starts below 0 become 0; empty intervals go; blocks of a BED12 line that are
    broken give way to the whole interval; repeated names get a suffix.
    """
    lines = numbered_lines(spark, path).filter(~F.col("line").rlike(r"^(track|browser)\b") & (F.trim("line") != ""))
    mark = F.col("line").startswith("#")
    below = Window.orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    title = F.trim(F.regexp_replace("line", "^#+", ""))
    rows = lines.withColumn("group", F.first(F.when(mark, title), ignorenulls=True).over(below)).withColumn("group_ord", F.first(F.when(mark, F.col("ord")), ignorenulls=True).over(below)).filter(~mark)
    rows = rows.withColumn("f", F.split("line", r"\t| +")).withColumn("wide", F.first(F.size("f")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    f = F.col("f")
    start, end = F.greatest(f[1].cast("long"), F.lit(0)), f[2].cast("long")
    six, twelve = F.col("wide") >= 6, (F.col("wide") >= 12) & (F.size("f") >= 12)
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda v: v != ""), lambda v: v.cast("long"))
    sizes, starts = numbers(F.get(f, 10)), numbers(F.get(f, 11))
    blocks = F.transform(F.arrays_zip(starts.alias("a"), sizes.alias("b")), lambda z: F.struct((start + z["a"]).alias("start"), (start + z["a"] + z["b"]).alias("end")))
    count = F.get(f, 9).cast("int")
    sound = twelve & (F.size(sizes) >= count) & (F.size(starts) >= count) & (count > 0) & ~F.exists(blocks, lambda b: b["start"].isNull() | b["end"].isNull() | (b["end"] <= b["start"]))
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    strand = F.when(six & F.get(f, 5).isin("+", "-"), F.get(f, 5)).otherwise(".")
    plain = F.concat(f[0], F.lit(":"), f[1], F.lit("-"), f[2])
    name = F.when(six & ~F.get(f, 3).isin(".", ""), F.get(f, 3)).otherwise(plain)
    out = rows.filter(end > start).select(
        "ord", f[0].alias("chrom"), F.when(sound, F.slice(blocks, F.lit(1), F.greatest(count, F.lit(1)))).otherwise(whole).cast(BLOCKS).alias("blocks"), name.alias("name"),
        F.coalesce("group", F.lit(default_group)).alias("group"), F.coalesce("group_ord", F.lit(1 << 60)).alias("group_ord"), strand.alias("strand"), F.when(six, _score(F.get(f, 4))).alias("score"),
    )
    out = _unique_names(out, "ord")
    return out.withColumn("group_id", (F.dense_rank().over(Window.orderBy("group_ord")) - 1).cast("int")).withColumn("row_id", F.col("ord")).drop("group_ord")


def _attribute(column: str, key: str) -> Column:
    return F.regexp_extract(column, rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1)


def read_gtf(spark: SparkSession, path: str, transcript: str = "transcript", exon: str = "exon", designator: str = "transcript_id", keep_exons: bool = False, group: str = "genes", group_attribute: str | None = None) -> DataFrame:
    """Transcripts of a GTF file as regions; with keep_exons, their exons as blocks. Of repeated ids the first stays. Starts count from 1 there.

    group_attribute groups them by an attribute, in the order in which its values first occur; group names those without it.
    """
    rows = numbered_lines(spark, path).filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).filter(F.size("f") >= 9)
    f = F.col("f")
    rows = rows.select("ord", f[0].alias("chrom"), f[2].alias("feature"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), f[5].alias("score_text"), f[6].alias("strand"), f[8].alias("attributes")).filter("end > start")
    rows = rows.withColumn("name", _attribute("attributes", designator)).filter("name <> ''")
    rows = rows.withColumn("group", F.lit(group) if group_attribute is None else F.coalesce(F.nullif(F.trim(_attribute("attributes", group_attribute)), F.lit("")), F.lit(group)))
    heads = rows.filter(F.col("feature") == transcript).groupBy("name").agg(F.min_by(F.struct("ord", "chrom", "start", "end", "strand", "score_text", "group"), "ord").alias("h")).select("name", "h.*")
    whole = F.array(F.struct("start", "end")).cast(BLOCKS)
    if keep_exons:
        exons = rows.filter(F.col("feature") == exon).groupBy("name").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).cast(BLOCKS).alias("exons"))
        heads = heads.join(exons, "name", "left")
        whole = F.coalesce("exons", whole)
    strand = F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".")
    if group_attribute is None:
        heads = heads.withColumn("group_id", F.lit(0))
    else:  # as many rows as there are groups
        groups = heads.groupBy("group").agg(F.min("ord").alias("_first"))
        heads = heads.join(groups.select("group", (F.row_number().over(Window.orderBy("_first")) - 1).alias("group_id")), "group")
    return heads.select(F.col("ord").alias("row_id"), "ord", "chrom", whole.alias("blocks"), "name", "group", strand.alias("strand"), _score(F.col("score_text")).alias("score"), "group_id")


def is_gtf(spark: SparkSession, path: str) -> bool:
    """By content: the first data line has nine fields, a number in the fourth and fifth, and attributes."""
    for row in spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).limit(1).collect():
        f = row["value"].split("\t")
        return len(f) >= 9 and f[3].isdigit() and f[4].isdigit() and f[6] in "+-."
    return False


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, strand of a black- or whitelist (BED or GTF), merged by strand."""
    if is_gtf(spark, path):
        rows = numbered_lines(spark, path).filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).filter(F.size("f") >= 7)
        f = F.col("f")
        rows = rows.select(f[0].alias("chrom"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"))
    else:
        f = F.split("value", r"[\t ]+")
        lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))
        rows = lines.select(f[0].alias("chrom"), F.greatest(f[1].cast("long"), F.lit(0)).alias("start"), f[2].cast("long").alias("end"), F.get(f, F.lit(5)).alias("strand"))
    rows = rows.filter("end > start").withColumn("strand", F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("."))
    return I.merge(rows, ["chrom", "strand"])


def probes(mask: DataFrame) -> DataFrame:
    """Stranded intervals without the bases that both strands cover."""
    plus, minus = (I.merge(mask.filter(F.col("strand") == s)) for s in "+-")
    return I.subtract(plus, minus).withColumn("strand", F.lit("+")).unionByName(I.subtract(minus, plus).withColumn("strand", F.lit("-")))


def read_bedgraph(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    f = F.split("value", r"[\t ]+")
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))
    return lines.select(F.lit(sample).alias("sample"), F.lit(sample).alias("source"), f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), finite(f[3].cast("double")).cast("float").alias("value"))


def _general(value: Column, digits: int) -> Column:
    """As C's %g prints it."""

    def one(v: Column) -> Column:
        exponent = F.when(v == 0, 0).otherwise(F.regexp_extract(F.format_string(f"%.{digits - 1}e", v), r"e([-+]\d+)$", 1).cast("int"))
        trim = lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)
        fixed = F.lit(None).cast("string")
        for e in range(-4, digits):
            fixed = F.when(exponent == e, trim(F.format_string(f"%.{digits - 1 - e}f", v))).otherwise(fixed)
        scientific = F.format_string(f"%.{digits - 1}e", v)
        return F.coalesce(fixed, F.concat(trim(F.regexp_extract(scientific, "^(.*)e", 1)), F.lit("e"), F.regexp_extract(scientific, r"e(.*)$", 1)))

    return F.when(value.isNull(), "nan").otherwise(F.element_at(F.transform(F.array(value.cast("double")), one), 1))


def write_bedgraph(track: DataFrame, chrom_sizes: DataFrame, path: str, compress: bool = False) -> None:
    """chrom, start, end, value in chromosome order: sorted by range, a file for each part."""
    rows = track.join(F.broadcast(chrom_sizes.select("chrom", "ord")), "chrom").orderBy("ord", "start")
    text = rows.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), _general(F.col("value"), 6)).alias("value"))
    text.write.option("compression", "gzip" if compress else "none").text(path)


def write_chrom_sizes(chrom_sizes: DataFrame, path: str) -> None:
    chrom_sizes.orderBy("ord").select(F.concat_ws("\t", "chrom", F.col("length").cast("string")).alias("value")).write.text(path)


# --- stored matrices ----------------------------------------------------------------------------------------------------

#: Header fields that hold one number for each sample.
PER_SAMPLE = ("upstream", "downstream", "body", "bin size", "ref point", "unscaled 5 prime", "unscaled 3 prime")


def check_header(header: dict) -> dict:
    """The header with per-sample fields as lists; an error where it contradicts itself."""
    missing = [k for k in ("group_boundaries", "sample_boundaries", "group_labels", "sample_labels") if k not in header]
    if missing:
        raise ValueError(f"the matrix header lacks {', '.join(missing)}")
    for name, strict in (("group", False), ("sample", True)):
        bounds, labels = header[f"{name}_boundaries"], header[f"{name}_labels"]
        if not bounds or bounds[0] != 0 or any(b < a or strict and b == a for a, b in zip(bounds, bounds[1:])):
            raise ValueError(f"{name} boundaries must rise from 0")
        if len(labels) != len(bounds) - 1:
            raise ValueError(f"{len(labels)} {name} labels for {len(bounds) - 1} {name}s")
    n, out = len(header["sample_labels"]), dict(header)
    for key in PER_SAMPLE:
        value = header.get(key)
        values = value if isinstance(value, list) else [value] * n
        if value is not None and len(values) not in (1, n):
            raise ValueError(f"{key} has {len(values)} values for {n} samples")
        if value is not None:
            out[key] = values * n if len(values) == 1 and n > 1 else values
    widths = [b - a for a, b in zip(header["sample_boundaries"], header["sample_boundaries"][1:])]
    if all(out.get(k) is not None for k in PER_SAMPLE if k != "ref point"):
        for i, width in enumerate(widths):
            if sum(out[k][i] for k in ("upstream", "downstream", "body", "unscaled 5 prime", "unscaled 3 prime")) // out["bin size"][i] > width:
                raise ValueError(f"sample {i + 1} claims more bins than it has")
    return out


def read_matrix(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, rows) of a matrix file: rows (row_id, group_id, ord, chrom, blocks, name, score, strand, sample, bins)."""
    first = spark.read.text(path).limit(1).collect()[0]["value"]
    header = check_header(json.loads(first.lstrip("@")))
    lines = numbered_lines(spark, path).filter("ord > 0").withColumn("f", F.split("line", "\t")).withColumn("ord", F.col("ord") - 1)
    f = F.col("f")
    bounds, groups = header["sample_boundaries"], header["group_boundaries"]
    wrong = F.size("f") != bounds[-1] + 6
    starts, ends = (F.transform(F.split(f[i], ","), lambda v: v.cast("long")) for i in (1, 2))
    blocks = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.struct(z["a"].alias("start"), z["b"].alias("end"))).cast(BLOCKS)
    group = F.lit(len(groups) - 2)
    for g in range(len(groups) - 3, -1, -1):
        group = F.when(F.col("ord") < groups[g + 1], g).otherwise(group)
    number = lambda v: narrow(finite(F.when(F.lower(v).isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity"), None).otherwise(v).cast("double")))
    samples = F.array(*[F.struct(F.lit(s).alias("sample"), F.transform(F.slice("f", F.lit(7 + a), F.lit(b - a)), number).alias("bins")) for s, (a, b) in enumerate(zip(bounds, bounds[1:]))])
    rows = lines.select(
        F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of fields in row "), F.col("ord").cast("string"))).cast("long")).otherwise(F.col("ord")).alias("row_id"), group.cast("int").alias("group_id"), "ord",
        f[0].alias("chrom"), blocks.alias("blocks"), f[3].alias("name"), _score(f[4]).alias("score"), f[5].alias("strand"), F.explode(samples).alias("s"),
    )
    return header, rows.select("row_id", "group_id", "ord", "chrom", "blocks", "name", "score", "strand", "s.sample", "s.bins")


def matrix_header(header: dict, matrix: DataFrame, group_labels: list[str], sample_labels: list[str]) -> dict:
    """The header that belongs to rows: boundaries are counted."""
    rows = {r["group_id"]: r["n"] for r in matrix.select("row_id", "group_id").distinct().groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    widths = {r["sample"]: r["w"] for r in matrix.groupBy("sample").agg(F.max(F.size("bins")).alias("w")).collect()}
    groups, samples = [0], [0]
    for g in range(len(group_labels)):
        groups.append(groups[-1] + rows.get(g, 0))
    for s in range(len(sample_labels)):
        samples.append(samples[-1] + widths.get(s, 0))
    return header | {"group_labels": group_labels, "sample_labels": sample_labels, "group_boundaries": groups, "sample_boundaries": samples}


def score_text(score: Column) -> Column:
    """A region's score as stored: a dot where there is none, whole numbers with one decimal."""
    return F.when(score.isNull(), ".").when((score == F.floor(score)) & (F.abs(score) < 1e15), F.format_string("%.1f", score)).otherwise(score.cast("string"))


def fixed_text(value: Column, digits: int) -> Column:
    """A single-precision value with fixed decimals as C's printf writes it: ties to even, where Java's formatter rounds them up."""

    def of(v: Column) -> Column:
        even = let(F.bround(v, digits), lambda r: F.format_string(f"%.{digits}f", F.when(r == 0, v * 0.0).otherwise(r)))  # zeros keep their sign
        return F.when(v.isNull() | F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(even)

    return let(value.cast("double"), of)


def matrix_lines(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """(group_id, ord, line): a stored row's text, values with fixed decimals."""
    value = lambda v: fixed_text(v, digits)
    meta = ["chrom", "blocks", "name", "score", "strand"]
    rows = matrix.groupBy("row_id", "group_id", "ord").agg(*[F.first(c).alias(c) for c in meta], F.sort_array(F.collect_list(F.struct("sample", "bins"))).alias("p"))
    joined = lambda name: F.array_join(F.transform("blocks", lambda b: b[name].cast("string")), ",")
    cells = F.array_join(F.transform(F.flatten(F.col("p.bins")), value), "\t")
    score = score_text(F.col("score"))
    return rows.select("group_id", "ord", F.concat_ws("\t", "chrom", joined("start"), joined("end"), "name", score, "strand", cells).alias("line"))


def write_matrix(header: dict, matrix: DataFrame, path: str, compress: bool = False) -> None:
    """A folder of text parts in order; the first part begins with the header line."""
    head = matrix.sparkSession.createDataFrame([(-1, -1, "@" + json.dumps(header))], "group_id int, ord long, line string")
    lines = head.unionByName(matrix_lines(matrix).select(F.col("group_id").cast("int"), F.col("ord").cast("long"), "line")).orderBy("group_id", "ord")
    lines.select("line").write.option("compression", "gzip" if compress else "none").text(path)


def value_table(matrix: DataFrame, path: str | None = None) -> DataFrame:
    """Values only, four significant digits, one line for each row."""
    rows = matrix.groupBy("row_id", "group_id", "ord").agg(F.sort_array(F.collect_list(F.struct("sample", "bins"))).alias("p")).orderBy("group_id", "ord")
    out = rows.select(F.array_join(F.transform(F.flatten(F.col("p.bins")), lambda v: _general(v, 4)), "\t").alias("value"))
    if path:
        out.write.text(path)
    return out


def sorted_regions(matrix: DataFrame, group_labels: list[str]) -> DataFrame:
    """BED12 lines with the group, in layout order."""
    label = F.element_at(F.array(*[F.lit(x) for x in group_labels]), F.col("group_id") + 1)
    rows = matrix.groupBy("row_id", "group_id", "ord").agg(*[F.first(c).alias(c) for c in ("chrom", "blocks", "name", "score", "strand")]).orderBy("group_id", "ord")
    start, end = F.col("blocks")[0]["start"], F.element_at("blocks", -1)["end"]
    sizes = F.array_join(F.transform("blocks", lambda b: (b["end"] - b["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("blocks", lambda b: (b["start"] - F.col("blocks")[0]["start"]).cast("string")), ",")
    score = score_text(F.col("score"))
    return rows.select(F.concat_ws("\t", "chrom", start.cast("string"), end.cast("string"), "name", score, "strand", start.cast("string"), end.cast("string"), F.lit("0"), F.size("blocks").cast("string"), sizes, starts, label).alias("value"))


def profile_table(profiles: DataFrame, group_labels: list[str], sample_labels: list[str]) -> DataFrame:
    """Lines (sample, group, part, values by bin, fifteen digits) for centre, lower and upper."""
    parts = profiles.groupBy("group_id", "sample").agg(F.sort_array(F.collect_list(F.struct("bin", "centre", "lower", "upper"))).alias("p"))
    named = lambda labels, c: F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(c) + 1)
    rows = parts.withColumn("part", F.explode(F.array(F.lit("centre"), F.lit("lower"), F.lit("upper"))))
    value = lambda p: F.when(F.col("part") == "centre", p["centre"]).when(F.col("part") == "lower", p["lower"]).otherwise(p["upper"])
    shown = rows.filter((F.col("part") == "centre") | F.exists("p", lambda p: p["lower"].isNotNull()))
    return shown.orderBy("sample", "group_id", "part").select(F.concat_ws("\t", named(sample_labels, "sample"), named(group_labels, "group_id"), "part", F.array_join(F.transform("p", lambda p: _general(value(p), 15)), "\t")).alias("value"))
