"""Programs over files: coverage, tracks, matrices. Options are checked before any file is opened; outputs are written to
a staging folder and renamed, all of them or none. Outputs are paths of a file system that the driver can rename in."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.labels import file_label, unique_labels
from tracklake.operators import clusters as K
from tracklake.operators import coverage as C
from tracklake.operators import matrices as X
from tracklake.operators import matrix_build as B
from tracklake.operators import tracks as T
from tracklake.sources import bam, bigwig, text


@contextmanager
def published(*paths: str, inputs: tuple[str, ...] = ()):
    """Staging paths for outputs; renamed together at the end, removed on an error. An output may not be an input."""
    same = {os.path.realpath(p) for p in inputs} & {os.path.realpath(p) for p in paths}
    if same or len({os.path.realpath(p) for p in paths}) < len(paths):
        raise ValueError(f"an output is an input or another output: {sorted(same) or paths}")
    staged = [f"{p}.{uuid.uuid4().hex}.part" for p in paths]
    kept: list[tuple[str, str]] = []
    try:
        yield staged
        for part, path in zip(staged, paths):
            if os.path.exists(path):
                aside = f"{part}.old"
                os.rename(path, aside)
                kept.append((aside, path))
            os.rename(part, path)
    except BaseException:
        for aside, path in kept:
            if os.path.exists(aside):
                shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
                os.rename(aside, path)
        raise
    finally:
        for p in [*staged, *(a for a, _ in kept)]:
            shutil.rmtree(p, ignore_errors=True) if os.path.isdir(p) else os.path.exists(p) and os.remove(p)


def merged_options(*layers: dict) -> dict:
    """Later layers win, folder by folder; values of None are left out."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_options(out.get(k) or {}, v) if isinstance(v, dict) else out.get(k) if v is None else v
    return out


def options_file(path: str) -> dict:
    """Options of a JSON file; a missing or broken file gives none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    if path.endswith(".cram"):
        raise ValueError("CRAM files need a codec that is not installed")
    return bam.read_bam(spark, path) if path.endswith(".bam") else text.read_sam(spark, path)


def read_track(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    return text.read_bedgraph(spark, path, sample) if ".bedgraph" in path.lower() or path.endswith((".bg", ".bg.gz")) else bigwig.read_bigwig(spark, path, sample)


def read_regions(spark: SparkSession, path: str, **options) -> DataFrame:
    return text.read_gtf(spark, path, **options) if text.is_gtf(spark, path) else text.read_bed(spark, path)


FORMATS = ("bigwig", "bedgraph")


def track_format(path: str, named: str | None = None) -> tuple[str, bool]:
    """(format, compressed) of an output: the format asked for, or the one that the file's name says; bigWig is the rule."""
    if named is not None and named not in FORMATS:
        raise ValueError(f"a track's format is one of {', '.join(FORMATS)}")
    plain = path.lower().removesuffix(".gz")
    known = named or ("bedgraph" if plain.endswith((".bedgraph", ".bdg", ".bg")) else "bigwig")
    return known, known == "bedgraph" and path.lower().endswith(".gz")


def write_track(track: DataFrame, sizes: DataFrame, path: str, format: tuple[str, bool]) -> None:
    if format[0] == "bedgraph":
        text.write_bedgraph(track, sizes, path, format[1])
    else:
        bigwig.write_bigwig(track, sizes, path)


def coverage(spark: SparkSession, source: str, output: str, spec: C.Coverage | None = None, blacklist: str | None = None, whitelist: str | None = None, probes: str | None = None, format: str | None = None) -> str:
    """Alignments to a track file; with split strands, to two files with .plus and .minus. Returns the library's strandedness."""
    spec, kind = spec or C.Coverage(), track_format(output, format)
    reads, sizes = read_alignments(spark, source)
    if probes:
        spec = replace(spec, library=C.strandedness(reads, text.probes(text.read_mask(spark, probes))).first()["library"])
    lists = {name: text.read_mask(spark, path) for name, path in (("blacklist", blacklist), ("whitelist", whitelist)) if path}
    track = C.coverage(reads, sizes, spec, **lists)
    stem, ext = os.path.splitext(output.removesuffix(".gz"))
    ext += ".gz" if output.endswith(".gz") else ""
    outputs = [f"{stem}.plus{ext}", f"{stem}.minus{ext}"] if spec.strand == "split" else [output]
    with published(*outputs, inputs=(source,)) as staged:
        for part, strand in zip(staged, "+-" if spec.strand == "split" else "."):
            write_track(track.filter(F.col("strand") == strand), sizes, part, kind)
    return spec.library


def track_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = None
    for i, path in enumerate(paths):
        part = read_track(spark, path, i)
        rows = part if rows is None else rows.unionByName(part)
    return T.info(rows)


def track_scale(spark: SparkSession, source: str, output: str, factor: float) -> None:
    with published(output, inputs=(source,)) as (part,):
        write_track(T.scale(read_track(spark, source), factor), bigwig.chrom_sizes(spark, source), part, track_format(output))


def track_merge(spark: SparkSession, sources: list[str], output: str, bin_size: int, how: str = "sum", factor: float = 1.0) -> None:
    rows = sizes = None
    for i, path in enumerate(sources):
        part, own = read_track(spark, path, i), bigwig.chrom_sizes(spark, path).withColumn("sample", F.lit(i))
        rows, sizes = (part, own) if rows is None else (rows.unionByName(part), sizes.unionByName(own))
    order = T.merged_sizes(sizes).withColumn("ord", F.monotonically_increasing_id())
    with published(output, inputs=tuple(sources)) as (part,):
        write_track(C._runs(T.merge(rows, order, bin_size, how, len(sources), factor).withColumn("strand", F.lit(".")).select("chrom", "strand", "start", "end", "value"), ["chrom", "strand"]), order, part, track_format(output))


@dataclass(frozen=True)
class Matrix:
    """A matrix and its labels."""

    rows: DataFrame
    groups: list[str]
    samples: list[str]
    header: dict = field(default_factory=dict)


def compute_matrix(spark: SparkSession, tracks: list[str], regions: list[str], layout: B.Layout, statistic: str = "mean", missing_as_zero: bool = False, low: float | None = None, high: float | None = None, skip_zeros: bool = False, scale: float = 1.0, blacklist: str | None = None, hard_blacklist: bool = False, minus_tracks: list[str] | None = None, antisense: bool = False, sort: str = "keep", using: str = "mean", **gtf) -> Matrix:
    """Files to a matrix: statistic, track scale, strand sum, thresholds, global scale, order, all-zero rows."""
    minus = minus_tracks or []
    signal = sizes = None
    for i, path in enumerate([*tracks, *minus]):
        part, own = read_track(spark, path, i), bigwig.chrom_sizes(spark, path)
        signal, sizes = (part, own) if signal is None else (signal.unionByName(part), sizes)
    rows, groups = None, []
    for path in regions:
        part = read_regions(spark, path, **gtf)
        names = [r["group"] for r in part.select("group", "group_id").distinct().orderBy("group_id").collect()]
        names = [file_label(path) if n == "genes" and len(regions) > 1 else n for n in names]
        part = part.withColumn("group_id", F.col("group_id") + len(groups)).withColumn("file", F.lit(len(groups)))
        groups += names
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("row_id", F.col("row_id") + F.col("file").cast("long") * (1 << 40)).drop("file", "group")
    mask = text.read_mask(spark, blacklist) if blacklist else None
    built = B.build(rows, signal, sizes, layout, statistic, missing_as_zero, B.sources(rows, len(tracks), bool(minus), antisense), len(tracks) + len(minus), mask, hard_blacklist)
    if low is not None or high is not None:
        built = X.threshold(built, low, high)
    if scale != 1:
        built = built.withColumn("bins", X.scale(F.col("bins"), scale))
    if skip_zeros:
        built = X.skip_zeros(built)
    full = built.join(rows.select("row_id", "chrom", "blocks", "name", "score", "strand"), "row_id")
    if sort != "keep":
        full = X.arrange(full, X.sort_order(full, using, sort))
    samples = unique_labels([file_label(p) for p in tracks])
    samples = [s for name in samples for s in ((name, f"{name}_antisense") if antisense else (name,))]
    n = len(samples)
    header = {
        "upstream": [layout.upstream] * n, "downstream": [layout.downstream] * n, "body": [layout.body] * n, "bin size": [layout.bin_size] * n, "ref point": [None if layout.body else layout.anchor.upper()] * n,
        "unscaled 5 prime": [layout.unscaled5] * n, "unscaled 3 prime": [layout.unscaled3] * n, "bin avg type": statistic, "missing data as zero": missing_as_zero, "min threshold": low, "max threshold": high,
        "scale": scale, "skip zeros": skip_zeros, "sort regions": sort, "sort using": using,
    }
    return Matrix(full, groups, samples, header)


def load_matrix(spark: SparkSession, path: str) -> Matrix:
    header, rows = text.read_matrix(spark, path)
    return Matrix(rows, header["group_labels"], header["sample_labels"], header)


def save_matrix(matrix: Matrix, path: str) -> None:
    with published(path) as (part,):
        text.write_matrix(text.matrix_header(matrix.header, matrix.rows, matrix.groups, matrix.samples), matrix.rows, part, ".gz" in path)


def describe(matrix: Matrix) -> dict:
    """Header facts without the values."""
    head = matrix.header
    return {"groups": matrix.groups, "samples": matrix.samples, "group_boundaries": head.get("group_boundaries"), "sample_boundaries": head.get("sample_boundaries"), "geometry": {k: head.get(k) for k in text.PER_SAMPLE}}


STEPS = ("add", "subtract", "scale", "log2", "missing_to_zero", "scale_rows")


def transform(matrix: Matrix, steps: list[tuple]) -> Matrix:
    """Ordered arithmetic: (name, arguments...). The header keeps the history."""
    unknown = [s[0] for s in steps if s[0] not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    rows = matrix.rows
    for name, *arguments in steps:
        rows = rows.withColumn("bins", getattr(X, name)(F.col("bins"), *arguments))
    return replace(matrix, rows=rows, header=matrix.header | {"history": [*matrix.header.get("history", []), *map(list, steps)]})


def bind_rows(matrices: list[Matrix], blind: bool = False) -> Matrix:
    first = matrices[0]
    for m in matrices[1:]:
        same = len(m.samples) == len(first.samples) and (blind or m.samples == first.samples and all(m.header.get(k) == first.header.get(k) for k in text.PER_SAMPLE))
        if not same:
            raise ValueError("matrices of different samples or geometry cannot be stacked")
    rows, groups = X.rbind([(m.rows, m.groups) for m in matrices], blind)
    return Matrix(rows, groups, first.samples, first.header)


def bind_columns(first: Matrix, second: Matrix, blind: bool = False) -> Matrix:
    identity = ["group_id", "chrom", "blocks", "name", "score", "strand"]
    if not blind and X.cbind_repeats(second.rows, identity).limit(1).count():
        raise ValueError("a region occurs twice in a group: bind by position instead")
    rows = X.cbind(first.rows, second.rows, None if blind else identity)
    head = dict(first.header)
    for k in text.PER_SAMPLE:
        a, b = first.header.get(k), second.header.get(k)
        if a is not None and b is not None:
            head[k] = [*a, *b]
    return Matrix(rows, first.groups, unique_labels([*first.samples, *second.samples]), head)


@dataclass(frozen=True)
class Preparation:
    """What is done to a stored matrix before it is summarized, in this order."""

    nan_mode: str = "keep"
    groups: tuple[int, ...] | None = None
    clusters: int = 0
    linkage: str = "kmeans"
    quantiles: int = 1
    sort: str = "keep"
    using: str = "mean"
    silhouette: bool = False
    samples: tuple[int, ...] | None = None


def prepare(matrix: Matrix, spec: Preparation) -> tuple[Matrix, DataFrame | None]:
    """Missing-value filter, group choice, clusters, empty groups, quantiles and order; and silhouettes, if asked."""
    rows, groups = matrix.rows, list(matrix.groups)
    chosen = list(spec.samples) if spec.samples else None
    if spec.nan_mode != "keep":
        rows = X.filter_values(rows, nan_mode=spec.nan_mode, samples=chosen)
    if spec.groups is not None:
        rows, groups = X.subset_groups(rows, list(spec.groups)), [groups[g] for g in spec.groups]
    scores = None
    if spec.clusters:
        found = (K.kmeans if spec.linkage == "kmeans" else K.ward)(K.row_vectors(rows, chosen), spec.clusters)
        scores = K.silhouettes(found) if spec.silhouette else None
        rows = rows.drop("group_id").join(found.select("row_id", F.col("cluster").cast("int").alias("group_id")), "row_id")
        groups = [f"cluster_{i + 1}" for i in range(spec.clusters)]
    groups, rows = X.drop_empty_groups(groups, rows)
    if spec.quantiles > 1:
        groups = [f"{groups[0]}_Q{q + 1}" for q in range(spec.quantiles)]
    if spec.sort != "keep":
        rows = X.arrange(rows, X.sort_order(rows, spec.using, spec.sort, spec.quantiles, chosen))
    return replace(matrix, rows=rows, groups=groups), scores


def known_options(kind: type) -> list[str]:
    return [f.name for f in fields(kind)]
