"""Region by signal matrices: zones of each region, an overlap join with the tracks, and a statistic for each bin.

A region is planned into zones: runs of segments that are cut into a number of equal bins. Segments join the tracks by
overlap, and all overlaps of a region meet in one row: that is the only grouping of a build. Arrow batches of such rows then
find each overlap's bins by integer arithmetic on its offset in the zone, and reduce them. Bins of n in a zone of L bases
cover [i L // n, max(that + 1, (i + 1) L // n)): short zones repeat bases.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from tracklake.functions.missing import finite
from tracklake.functions import alignments as A
from tracklake.operators import intervals as I
from tracklake.shipping import ship_code

ANCHORS = ("tss", "tes", "center")
STATISTICS = ("mean", "median", "min", "max", "sum")
#: Bins that a task reduces at once, about.
CELLS = 2_000_000
#: Bases of a join bucket: tracks have many short intervals, most of them shorter than a segment.
BUCKET = 512
SEGMENTS = "array<struct<zone:int,bins:int,size:bigint,first:int,at:bigint,s:bigint,e:bigint>>"


@dataclass(frozen=True)
class Layout:
    """Geometry of a matrix. body > 0 scales regions; else bins surround the anchor. All lengths are multiples of bin_size."""

    upstream: int = 0
    downstream: int = 0
    body: int = 0
    unscaled5: int = 0
    unscaled3: int = 0
    bin_size: int = 10
    anchor: str = "tss"
    stop_at_end: bool = False

    def __post_init__(self):
        lengths = (self.upstream, self.downstream, self.body, self.unscaled5, self.unscaled3)
        if self.bin_size < 1 or any(n < 0 or n % self.bin_size for n in lengths):
            raise ValueError("lengths must be multiples of the bin size")
        if self.anchor not in ANCHORS:
            raise ValueError("unknown anchor")
        if not self.body and (self.unscaled5 or self.unscaled3):
            raise ValueError("unscaled parts belong to scaled regions")

    @property
    def bins(self) -> int:
        return (self.upstream + self.downstream + self.body + self.unscaled5 + self.unscaled3) // self.bin_size


Blocks = list[tuple[int, int]]


def bases(blocks: Blocks) -> int:
    return sum(e - s for s, e in blocks)


def part(blocks: Blocks, begin: int, end: int) -> Blocks:
    """The blocks' bases with offsets in [begin, end)."""
    out, at = [], 0
    for s, e in blocks:
        a, b = max(begin - at, 0), min(end - at, e - s)
        if a < b:
            out.append((s + a, s + b))
        at += e - s
    return out


def _walked(inner: Blocks, want: int, leftwards: bool, stop: bool) -> tuple[Blocks, int]:
    """Bases along a region's blocks from an anchor; what they lack goes on past the region, or is missing with stop."""
    lack = want - bases(inner)
    if lack <= 0 or not inner:
        return inner, max(lack, 0)
    if stop:
        return inner, lack
    return ([(inner[0][0] - lack, inner[0][0]), *inner] if leftwards else [*inner, (inner[-1][1], inner[-1][1] + lack)]), 0


def plan(blocks: Blocks, minus: bool, layout: Layout) -> tuple[list[tuple[Blocks, int]], int, int] | None:
    """Zones [(segments, bins)] from left to right, with missing bins before and after; None for a region too short to scale."""
    w, n = layout.bin_size, bases(blocks)
    start, end = blocks[0][0], blocks[-1][1]
    left, right = (layout.downstream, layout.upstream) if minus else (layout.upstream, layout.downstream)
    before, after = [(start - left, start)] if left else [], [(end, end + right)] if right else []
    if layout.body:
        first, last = (layout.unscaled3, layout.unscaled5) if minus else (layout.unscaled5, layout.unscaled3)
        if n - first - last < w:
            return None
        zones = [(before, left // w), (part(blocks, 0, first), first // w), (part(blocks, first, n - last), layout.body // w), (part(blocks, n - last, n), last // w), (after, right // w)]
        return zones, 0, 0
    lack_left = lack_right = 0
    if layout.anchor == "center":
        middle = n // 2
        before, lack_left = _walked(part(blocks, max(middle - left, 0), middle), left, True, layout.stop_at_end)
        after, lack_right = _walked(part(blocks, middle, min(middle + right, n)), right, False, layout.stop_at_end)
        if not before and left and not layout.stop_at_end:
            before, lack_left = [(after[0][0] - left, after[0][0])], 0
        if bases(before) < w:
            before = []
        if bases(after) < w:
            after = []
    elif (layout.anchor == "tss") == minus:
        # The anchor is the region's right end: its blocks lie to the left of it.
        before, lack_left = _walked(part(blocks, max(n - left, 0), n) if left else [], left, True, layout.stop_at_end)
    else:
        after, lack_right = _walked(part(blocks, 0, right), right, False, layout.stop_at_end)
    a, e = bases(before) // w, bases(after) // w

    def missing(lack: int, want: int, have: int) -> int:
        if not lack:
            return 0
        pad = round(lack / w)
        return pad + (want // w - pad - have > 0)

    return [(before, a), (after, e)], missing(lack_left, left, a), missing(lack_right, right, e)


def planned(regions: DataFrame, layout: Layout) -> DataFrame:
    """Regions (row_id, chrom, blocks, strand, ...) with their segments; regions too short to scale go."""

    def run(batches):
        for batch in batches:
            keep, rows = [], []
            for k, (blocks, minus) in enumerate(zip(batch.column("blocks").to_pylist(), batch.column("minus").to_pylist())):
                found = plan([(b["start"], b["end"]) for b in blocks], minus, layout)
                if found is None:
                    continue
                zones, pad, _ = found
                segments, first = [], pad
                for z, (parts, bins) in enumerate(zones):
                    at, size = 0, bases(parts)
                    for s, e in parts:
                        if bins and e > s:
                            segments.append({"zone": z, "bins": bins, "size": size, "first": first, "at": at, "s": s, "e": e})
                        at += e - s
                    first += bins
                keep.append(k)
                rows.append(segments)
            out = batch.take(pa.array(keep, pa.int64()))
            kind = pa.list_(pa.struct([("zone", pa.int32()), ("bins", pa.int32()), ("size", pa.int64()), ("first", pa.int32()), ("at", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rows, kind)], [*out.schema.names, "segments"])

    given = regions if "minus" in regions.columns else regions.withColumn("minus", F.col("strand") == "-")
    ship_code(given.sparkSession)
    kind = given.limit(0).select(F.lit(None).cast(SEGMENTS).alias("segments")).schema["segments"]
    return given.mapInArrow(run, StructType([*given.schema.fields, kind]))


def spread(first: np.ndarray, bins: np.ndarray, size: np.ndarray, o1: np.ndarray, o2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For zone offsets [o1, o2): (number of the given offset, bin, width of the overlap) for each bin that they touch."""
    low = np.where(size >= bins, ((o1 + 1) * bins - 1) // size, (o1 * bins + size - 1) // size)
    count = (o2 * bins - 1) // size - low + 1
    of = np.repeat(np.arange(len(o1)), count)
    i = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    n, total = bins[of], size[of]
    begin = i * total // n
    end = np.minimum(total, np.maximum(begin + 1, (i + 1) * total // n))
    width = np.minimum(o2[of], end) - np.maximum(o1[of], begin)
    some = width > 0
    return of[some], (first[of] + i)[some], width[some]


def medians(cell: np.ndarray, v: np.ndarray, width: np.ndarray, cells: int) -> np.ndarray:
    """Median of each cell's values, each repeated `width` times; cells without values are 0."""
    order = np.lexsort((v, cell))
    cell, v, width = cell[order], v[order], width[order]
    n = np.bincount(cell, weights=width, minlength=cells).astype(np.int64)
    ends, before = np.cumsum(width), np.cumsum(n) - n
    some = np.flatnonzero(n)
    out = np.zeros(cells)
    pick = lambda k: v[np.searchsorted(ends, before[some] + k, side="right")]
    out[some] = (pick((n[some] - 1) // 2) + pick(n[some] // 2)) / 2
    return out


def reduced(cell: np.ndarray, v: np.ndarray, width: np.ndarray, room: np.ndarray | None, cells: int, statistic: str) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether there is one) of each cell from the overlaps in it. room: bases of each cell, of which those without a value are 0."""
    covered = np.bincount(cell, weights=width, minlength=cells)
    bases_of = covered if room is None else room
    there = bases_of > 0
    if statistic in ("mean", "sum"):
        total = np.bincount(cell, weights=v * width, minlength=cells)
        return (total if statistic == "sum" else total / np.where(there, bases_of, 1)), there
    if room is not None:
        gap = room - covered
        zero = np.flatnonzero(gap > 0)
        cell, v, width = np.r_[cell, zero], np.r_[v, np.zeros(len(zero))], np.r_[width, gap[zero].astype(np.int64)]
    if statistic == "median":
        return medians(cell, v, width, cells), there
    best = np.full(cells, np.inf if statistic == "min" else -np.inf)
    (np.minimum if statistic == "min" else np.maximum).at(best, cell, v)
    return np.where(there, best, 0.0), there


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    """Row numbers and fields of an array<struct> column."""
    flat = pc.list_flatten(column)
    return [pc.list_parent_indices(column).to_numpy(zero_copy_only=False), *(c.to_numpy(zero_copy_only=False) for c in flat.flatten())]


def _matrix_rows(batch: pa.RecordBatch, bins: int, count: int, statistic: str, as_zero: bool) -> pa.RecordBatch:
    """(row_id, group_id, ord, sample, bins) of gathered regions."""
    rows = batch.num_rows
    row, source, first, n, size, o1, o2, v = _unpacked(batch.column("hits"))
    of, at, width = spread(first.astype(np.int64), n.astype(np.int64), size, o1, o2)
    cell = (row[of].astype(np.int64) * count + source[of]) * bins + at
    room = None
    if as_zero:
        row, first, n, size, o1, o2 = _unpacked(batch.column("room"))
        whose, place, bases_there = spread(first.astype(np.int64), n.astype(np.int64), size, o1, o2)
        own = np.bincount(row[whose].astype(np.int64) * bins + place, weights=bases_there, minlength=rows * bins).reshape(rows, 1, bins)
        room = np.broadcast_to(own, (rows, count, bins)).ravel()
    value, there = reduced(cell, v[of], width, room, rows * count * bins, statistic)
    value, there = value.reshape(rows, count, bins), there.reshape(rows, count, bins)
    row, sample, source, factor, parts = _unpacked(batch.column("wanted"))
    pair, made = np.unique(row.astype(np.int64) << 32 | sample, return_inverse=True)
    out, seen, asked = np.zeros((len(pair), bins)), np.zeros((len(pair), bins), np.int64), np.zeros(len(pair), np.int64)
    np.add.at(out, made, np.where(there[row, source], value[row, source] * factor[:, None], 0.0))
    np.add.at(seen, made, there[row, source])
    np.maximum.at(asked, made, parts)
    # Both strands of a summed sample have to be present.
    there = seen == asked[:, None]
    row, sample = pair >> 32, pair & 0xFFFFFFFF
    minus = batch.column("minus").to_numpy(zero_copy_only=False)[row].astype(bool)
    out[minus], there[minus] = out[minus][:, ::-1], there[minus][:, ::-1]
    with np.errstate(over="ignore"):
        small = out.astype(np.float32)
    if (np.isinf(small) & there).any():
        raise ValueError("a value exceeds the range of single precision")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pair) + 1) * bins, pa.int32()), pa.array(small.ravel(), mask=~there.ravel()))
    taken = [batch.column(c).take(pa.array(row)) for c in ("row_id", "group_id", "ord")]
    return pa.RecordBatch.from_arrays([*taken, pa.array(sample, pa.int32()), lists], ["row_id", "group_id", "ord", "sample", "bins"])


def sources(regions: DataFrame, tracks: int, stranded: bool = False, antisense: bool = False, unstranded: str = "sum_strands", scale_plus: float = 1.0, scale_minus: float = 1.0, scale_antisense: float = 1.0) -> Column:
    """array<struct<sample, source, factor, parts>>: which tracks make each output sample of a region.

    With stranded tracks, source i is plus and tracks + i is minus. A region reads the track of its own strand, its
    antisense samples (which follow each sense sample) the other; unstranded regions the sum of both, or one of them.
    Rows of antisense groups (a column reads_other) read the other strand as well, at the antisense scale.
    """
    if unstranded not in ("sum_strands", "as_plus", "as_minus"):
        raise ValueError("unknown handling of unstranded regions")
    kind = "array<struct<sample:int,source:int,factor:double,parts:int>>"
    roles = (False, True) if antisense else (False,)
    flipped = F.col("reads_other") if "reads_other" in regions.columns else F.lit(False)
    own_minus = F.when(F.col("strand").isin("+", "-"), F.col("strand") == "-").otherwise(F.lit(unstranded == "as_minus"))
    out = []
    for i in range(tracks):
        for k, other in enumerate(roles):
            sample, extra = i * len(roles) + k, F.when(flipped | F.lit(other), F.lit(float(scale_antisense))).otherwise(F.lit(1.0))
            one = lambda source, factor, parts: F.struct(F.lit(sample).alias("sample"), source.cast("int").alias("source"), factor.cast("double").alias("factor"), F.lit(parts).alias("parts"))  # noqa: B023, E731
            if not stranded:
                out.append(F.array(one(F.lit(i), scale_plus * extra, 1)))
                continue
            minus = own_minus != (flipped | F.lit(other))
            single = F.array(one(F.when(minus, tracks + i).otherwise(i), F.when(minus, scale_minus * extra).otherwise(scale_plus * extra), 1))
            both = F.array(one(F.lit(i), scale_plus * extra, 2), one(F.lit(tracks + i), scale_minus * extra, 2))
            out.append(F.when(~F.col("strand").isin("+", "-") & F.lit(unstranded == "sum_strands"), both).otherwise(single))
    return F.concat(*out).cast(kind)


def build(regions: DataFrame, tracks: DataFrame, sizes: DataFrame, layout: Layout, statistic: str = "mean", missing_as_zero: bool = False, wanted: Column | None = None, tracks_count: int | None = None, mask: DataFrame | None = None, hard_mask: bool = False) -> DataFrame:
    """Matrix rows (row_id, group_id, ord, sample, bins) of regions (row_id, group_id, ord, chrom, blocks, strand).

    tracks: source, chrom, start, end, value with disjoint intervals for each source. Bases beyond the chromosome or in
    gaps are missing, or 0 with missing_as_zero; masked bases are missing even then. wanted: as `sources` gives it.
    """
    if statistic not in STATISTICS:
        raise ValueError("unknown statistic")
    count = tracks_count or (tracks.agg(F.max("source")).first()[0] or 0) + 1
    unstranded_minus = F.col("strand") == "-"
    rows = planned(regions.withColumn("minus", unstranded_minus).withColumn("wanted", wanted if wanted is not None else sources(regions, count)), layout)
    rows = rows.filter(F.size("segments") > 0)
    if mask is not None:
        spans = rows.select("row_id", "chrom", F.explode("segments").alias("g")).select("row_id", "chrom", F.col("g.s").alias("start"), F.col("g.e").alias("end"))
        touched = I.overlap_join(spans, mask.select("chrom", "start", "end"))
        if hard_mask:
            rows = rows.join(touched.select("row_id").distinct(), "row_id", "left_anti")
        else:
            gaps = touched.groupBy("row_id").agg(F.sort_array(F.collect_set(F.struct(F.col("r_start").cast("bigint").alias("s"), F.col("r_end").cast("bigint").alias("e")))).alias("gaps"))
            rows = rows.join(gaps, "row_id", "left")
    span = lambda g: F.array(F.struct(g["s"].alias("s"), g["e"].alias("e")))
    seen = lambda g: span(g) if mask is None or hard_mask else F.when(F.col("gaps").isNull(), span(g)).otherwise(I.subtracted_array(span(g), F.coalesce("gaps", F.array().cast(A.BLOCK))))
    piece = lambda g, p: F.struct(g["first"].alias("first"), g["bins"].alias("bins"), g["size"].alias("size"), (g["at"] - g["s"] + p["s"]).alias("o1"), (g["at"] - g["s"] + p["e"]).alias("o2"), p["s"].alias("s"))
    rows = rows.withColumn("pieces", F.flatten(F.transform("segments", lambda g: F.transform(seen(g), lambda p: piece(g, p)))))
    # Only bases without a value need all of a region's pieces.
    room = F.transform("pieces", lambda p: p.dropFields("s")) if missing_as_zero else F.array().cast("array<struct<first:int,bins:int,size:bigint,o1:bigint,o2:bigint>>")
    parts = rows.select("row_id", "group_id", "ord", "chrom", "minus", "wanted", room.alias("room"), F.explode_outer("pieces").alias("p"))
    parts = parts.withColumn("start", F.col("p.s")).withColumn("end", F.col("p.s") + F.col("p.o2") - F.col("p.o1"))
    signal = tracks.select("source", "chrom", "start", "end", finite(F.col("value")).alias("value")).filter("value is not null")
    joined = I.overlap_join(parts, I.clip(signal, sizes), width=BUCKET, keep_left=True)
    shift = F.col("p.o1") - F.col("p.s")
    hit = F.struct(
        F.col("r_source").cast("int").alias("source"), F.col("p.first").alias("first"), F.col("p.bins").alias("bins"), F.col("p.size").alias("size"),
        (F.greatest("start", "r_start") + shift).alias("o1"), (F.least("end", "r_end") + shift).alias("o2"), F.col("r_value").alias("v"),
    )
    once = ["group_id", "ord", "minus", "wanted", "room"]
    gathered = joined.groupBy("row_id").agg(*[F.first(c).alias(c) for c in once], F.collect_list(F.when(F.col("r_start").isNotNull(), hit)).alias("hits"))
    width = layout.bins
    step = max(1, CELLS // max(1, width * count))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield _matrix_rows(batch.slice(at, step), width, count, statistic, missing_as_zero)

    ship_code(gathered.sparkSession)
    fields = [f for f in gathered.schema.fields if f.name in ("row_id", "group_id", "ord")]
    return gathered.mapInArrow(run, StructType([*fields, StructField("sample", IntegerType()), StructField("bins", ArrayType(FloatType()))]))


def with_antisense_groups(regions: DataFrame) -> DataFrame:
    """Each region followed by a copy in a group of its own that reads the other strand; layout and orientation stay."""
    copies = regions.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return (
        copies.withColumn("group_id", F.col("group_id") * 2 + F.col("copy")).withColumn("name", F.when(F.col("copy") == 1, F.concat("name", F.lit("_antisense"))).otherwise(F.col("name")))
        .withColumn("row_id", F.col("row_id") * 2 + F.col("copy")).withColumn("reads_other", F.col("copy") == 1).drop("copy")
    )
