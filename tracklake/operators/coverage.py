"""Coverage: filtered alignments to binned, masked and normalized tracks.

Each retained record is shaped into blocks, fragments or points; mates are found by an equi-join on their exact key; the
blocks are expanded to the bins that they touch, and bins are aggregated on (chrom, lane, bin), pre-aggregated in each
task. Bins without signal are never materialized: zero runs are read off the gaps when bins are run-length encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions import alignments as A
from tracklake.functions.missing import narrow
from tracklake.operators import intervals as I

MODELS = ("plain", "extend", "5prime", "3prime", "center")
#: Bases of a tile: totals and runs are built within tiles first, so that no task orders a whole chromosome's bins.
TILE_BASES = 1 << 22
#: Bins below this size are totalled by changes.
FINE = 25
#: Rows that are put in order at once to draw a sample; values whose counts the driver holds.
ORDERED, VALUES = 100_000, 1 << 16
CHANGES = "array<struct<bin:bigint,own:bigint,change:bigint>>"


@dataclass(frozen=True)
class Coverage:
    """What to count. aggregation: mean, sum, count; normalization: none, cpm, rpkm, bpm (the last three count reads)."""

    bin_size: int = 50
    aggregation: str = "mean"
    normalization: str = "none"
    denominator: str = "library"
    count_unit: str = "read"
    model: str = "plain"
    extend_length: int = 0
    collapsed_length: int = 1
    include: tuple[tuple[int, int], ...] = ()
    exclude: int = 0
    keep_duplicates: bool = True
    primary_only: bool = True
    min_mapq: int = 0
    min_fragment: int = 0
    max_fragment: int = 0
    library: str = "none"
    strand: str = "none"  # none, forward, reverse, split
    skip_introns: bool = False
    scale: float = 1.0
    scale_minus: float | None = None
    ignored: tuple[str, ...] = ()
    mask_mode: str = "bins"  # bins, fragments
    mask_strand: str = "ignore"  # ignore, sense, antisense

    def __post_init__(self):
        checks = (
            ("aggregation", ("mean", "sum", "count")), ("normalization", ("none", "cpm", "rpkm", "bpm")), ("denominator", ("library", "filtered")), ("count_unit", ("read", "fragment", "auto")),
            ("model", MODELS), ("library", ("none", "forward", "reverse")), ("strand", ("none", "forward", "reverse", "split")), ("mask_mode", ("bins", "fragments")), ("mask_strand", ("ignore", "sense", "antisense")),
        )
        for name, known in checks:
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if self.bin_size < 1 or self.collapsed_length < 1:
            raise ValueError("bin_size and collapsed_length must be positive")
        if self.normalization != "none" and self.aggregation != "count":
            raise ValueError("a normalization counts reads: aggregation must be count")
        if (self.strand != "none" or self.mask_strand != "ignore") and self.library == "none":
            raise ValueError("strands need the library's strandedness")
        if self.model == "extend" and self.extend_length < 1:
            raise ValueError("extend needs extend_length")

    @property
    def fragments(self) -> bool:
        """auto counts fragments where reads are extended or collapsed."""
        return self.count_unit == "fragment" or self.count_unit == "auto" and self.model != "plain"


def _columns(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) for c in df.columns}


def passes(spec: Coverage) -> Column:
    """Filters of single records (needs the columns of `described`)."""
    exclude = spec.exclude | A.FLAGS["UNMAP"] | (A.FLAGS["SECONDARY"] | A.FLAGS["SUPPLEMENTARY"] if spec.primary_only else 0) | (0 if spec.keep_duplicates else A.FLAGS["DUP"])
    flag = F.col("flag")
    keep = ~A.has(flag, exclude) & A.included(flag, list(spec.include)) & (F.col("mapq") >= spec.min_mapq)
    if spec.min_fragment > 0:
        keep &= F.col("span") >= spec.min_fragment
    if spec.max_fragment > 0:
        keep &= F.col("span") <= spec.max_fragment
    if spec.strand in ("forward", "reverse"):
        keep &= A.transcript_strand(flag, spec.library) == (1 if spec.strand == "forward" else -1)
    return keep


def described(records: DataFrame, spec: Coverage) -> DataFrame:
    """Records with their ends, spans, pair roles and eligibility."""
    df = records.withColumn("end", A.aligned_end(F.col("pos"), F.col("cigar"))).withColumn("span", A.fragment_length(F.col("tlen"), F.col("cigar")))
    r = _columns(df)
    reverse = A.has(r["flag"], A.FLAGS["REVERSE"])
    df = df.withColumn("proper", F.coalesce(A.is_proper(r), F.lit(False))).withColumn("dovetail", F.coalesce(A.is_dovetail(r), F.lit(False)) if spec.fragments else F.lit(False))
    paired = spec.fragments or spec.model == "extend"
    placer = (F.col("proper") & reverse) | (F.col("dovetail") & ~reverse)
    partner = (F.col("proper") & ~reverse) | (F.col("dovetail") & reverse)
    df = df.withColumn("placer", placer if paired else F.lit(False)).withColumn("partner", partner if paired else F.lit(False))
    return df.withColumn("eligible", passes(spec))


def _bits(flag: Column, mate: bool) -> Column:
    first, second = A.has(flag, A.FLAGS["READ1"]), A.has(flag, A.FLAGS["READ2"])
    return (F.when(second if mate else first, 1).otherwise(0) + F.when(first if mate else second, 2).otherwise(0)).cast("int")


def with_mates(df: DataFrame, spec: Coverage) -> DataFrame:
    """Adds mate_span, mate_blocks, mate_introns and mate_touch: the eligible mate's, or NULL where there is none or several differ.

    A mate has the same name and read group, starts where the record says, and names the record's place as its mate's.
    Secondary and supplementary records only have to be named by their primary mate's place.
    """
    flag = F.col("flag")
    primary = ~A.has(flag, A.FLAGS["SECONDARY"] | A.FLAGS["SUPPLEMENTARY"])
    facts = F.struct(
        F.col("eligible").alias("eligible"), F.when(F.col("eligible") & (F.col("placer") | F.col("partner")), F.col("span")).alias("span"),
        F.when(F.col("eligible"), A.blocks(F.col("pos"), F.col("cigar"))).alias("blocks"), F.when(F.col("eligible"), A.introns(F.col("pos"), F.col("cigar"))).alias("introns"),
        F.when(F.col("eligible"), F.col("touch")).alias("touch"),
    )
    group = F.coalesce("rg", F.lit(""))
    own = df.filter(primary & A.has(flag, A.FLAGS["PAIRED"])).select(
        F.col("qname").alias("k_name"), group.alias("k_group"), F.col("chrom").alias("k_chrom"), F.col("pos").alias("k_pos"), _bits(flag, False).alias("k_end"),
        F.col("mchrom").alias("k_mchrom"), F.col("mpos").alias("k_mpos"), facts.alias("facts"),
    )
    keys = ["k_name", "k_group", "k_chrom", "k_pos", "k_end", "k_mchrom", "k_mpos"]
    mates = own.groupBy(*keys).agg(F.min("facts").alias("low"), F.max("facts").alias("high")).filter("low = high").select(*keys, F.col("low").alias("mate"))
    asks = A.has(flag, A.FLAGS["PAIRED"]) & ~A.has(flag, A.FLAGS["MUNMAP"]) & (F.col("mpos") >= 0) & primary
    cond = (
        asks & (F.col("qname") == F.col("k_name")) & (group == F.col("k_group")) & (F.col("mchrom") == F.col("k_chrom")) & (F.col("mpos") == F.col("k_pos")) & (_bits(flag, True) == F.col("k_end"))
        & (F.col("chrom") == F.col("k_mchrom")) & (F.col("pos") == F.col("k_mpos"))
    )
    found = df.join(mates, cond, "left")
    if not spec.primary_only:
        loose_keys = keys[:5]
        loose = own.groupBy(*loose_keys).agg(F.min("facts").alias("low"), F.max("facts").alias("high")).filter("low = high").select(*[F.col(k).alias(f"l{k}") for k in loose_keys], F.col("low").alias("loose"))
        asks = ~primary & A.has(flag, A.FLAGS["PAIRED"]) & ~A.has(flag, A.FLAGS["MUNMAP"]) & (F.col("mpos") >= 0)
        cond = asks & (F.col("qname") == F.col("lk_name")) & (group == F.col("lk_group")) & (F.col("mchrom") == F.col("lk_chrom")) & (F.col("mpos") == F.col("lk_pos")) & (_bits(flag, True) == F.col("lk_end"))
        found = found.join(loose, cond, "left").withColumn("mate", F.coalesce("mate", "loose"))
    return found.select(*df.columns, F.col("mate.span").alias("mate_span"), F.col("mate.blocks").alias("mate_blocks"), F.col("mate.introns").alias("mate_introns"), F.col("mate.touch").alias("mate_touch"))


def _one(s: Column, e: Column) -> Column:
    return F.array(F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))).cast(A.BLOCK)


def _collapsed(s: Column, e: Column, sign: Column, spec: Coverage, limit: Column) -> Column:
    n = F.lit(spec.collapsed_length)
    middle = F.expr("0") + F.floor((s + e) / 2) - spec.collapsed_length // 2
    if spec.model == "center":
        a, b = middle, middle + n
    else:
        left = (sign >= 0) if spec.model == "5prime" else (sign < 0)
        a, b = F.when(left, s).otherwise(e - n), F.when(left, s + n).otherwise(e)
    return _one(F.greatest(a, s, F.lit(0)), F.least(b, e, limit))


def shaped(df: DataFrame, spec: Coverage) -> DataFrame:
    """Counted units: chrom, lane, length, iv (blocks) and weight. df comes from `with_mates`, or has no pairs."""
    flag, pos, end, limit = F.col("flag"), F.col("pos"), F.col("end"), F.col("length")
    reverse = A.has(flag, A.FLAGS["REVERSE"])
    sign = A.transcript_strand(flag, spec.library) if spec.library != "none" else F.when(reverse & ~F.col("proper"), -1).when(reverse & F.lit(not spec.fragments), -1).otherwise(1)
    # Bounds of a proper fragment: the reverse mate holds both ends, the forward mate alone has its |TLEN|.
    p_start = F.when(reverse, F.col("mpos")).otherwise(pos)
    p_end = F.least(F.when(reverse, end).otherwise(pos + F.col("span")), limit)
    matched = F.coalesce(F.col("mate_span") == F.col("span"), F.lit(False))
    pair = F.col("placer") & matched
    own_introns, mate_introns = A.introns(pos, F.col("cigar")), F.coalesce("mate_introns", F.array().cast(A.BLOCK))
    lone_blocks = A.blocks(pos, F.col("cigar"))
    both_start = F.least(pos, F.col("mate_blocks")[0]["s"])
    both_end = F.greatest(end, F.element_at("mate_blocks", -1)["e"])
    bridged = pair & F.col("dovetail") & (F.size("mate_blocks") > 0)
    weight = F.lit(1)
    if spec.model == "plain":
        iv = F.when(pair, I.merged_array(F.concat(lone_blocks, F.coalesce("mate_blocks", F.array().cast(A.BLOCK))))).otherwise(lone_blocks) if spec.fragments else lone_blocks
    elif spec.model == "extend":
        length = F.greatest(F.lit(spec.extend_length).cast("bigint"), end - pos)
        s = F.when(bridged, both_start).when(F.col("proper"), p_start).when(reverse, end - length).otherwise(pos)
        e = F.when(bridged, both_end).when(F.col("proper"), p_end).when(reverse, end).otherwise(pos + length)
        iv = _one(F.greatest(s, F.lit(0)), F.least(e, limit))
        if spec.skip_introns:
            iv = I.subtracted_array(iv, F.when(pair, F.concat(own_introns, mate_introns)).otherwise(own_introns))
        if not spec.fragments:
            weight = F.when(pair, 2).otherwise(1)
    else:
        whole = F.col("proper") & F.lit(spec.fragments)
        s = F.when(bridged, both_start).when(whole, p_start).otherwise(pos)
        e = F.when(bridged, both_end).when(whole, p_end).otherwise(end)
        iv = _collapsed(s, e, sign, spec, F.when(bridged, both_end).otherwise(limit))
    lanes = spec.strand == "split" or spec.mask_strand != "ignore"
    lane = F.when(A.transcript_strand(flag, spec.library) == 1, 0).otherwise(1) if lanes else F.lit(0)
    # The partner of a placed pair is counted through its placer.
    kept = df.filter(F.col("eligible") & ~(F.col("partner") & matched))
    unit = F.struct(lane.alias("lane"), F.filter(iv, lambda b: b["e"] > b["s"]).alias("iv"), weight.cast("long").alias("weight"))
    # A generator, not a filter: the optimizer would copy the walk over the blocks into filters below.
    one = F.explode(F.filter(F.array(unit), lambda u: F.size(u["iv"]) > 0)).alias("u")
    return kept.select("chrom", "length", one).select("chrom", "length", "u.*")


def _touches(df: DataFrame, regions: DataFrame, spec: Coverage) -> DataFrame:
    """row_id of the records of which an aligned block overlaps a region of the strand that the mask asks for."""
    blocks = df.dropDuplicates(["row_id"]).select("row_id", "chrom", A.transcript_strand(F.col("flag"), spec.library if spec.library != "none" else "forward").alias("sign"), F.explode(A.blocks(F.col("pos"), F.col("cigar"))).alias("b")).select("row_id", "chrom", "sign", F.col("b.s").alias("start"), F.col("b.e").alias("end"))
    found = I.overlap_join(blocks, regions.select("chrom", "start", "end", "strand"))
    if spec.mask_strand != "ignore":
        wanted = F.when((F.col("sign") == 1) == F.lit(spec.mask_strand == "sense"), "+").otherwise("-")
        found = found.filter((F.col("r_strand") == ".") | (F.col("r_strand") == wanted))
    return found.select("row_id").distinct()


def units(alignments: DataFrame, chrom_sizes: DataFrame, spec: Coverage, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """What is counted, before binning. alignments: qname, rg, flag, chrom, pos, mapq, cigar, mchrom, mpos, tlen."""
    df = described(alignments, spec).join(F.broadcast(chrom_sizes.select("chrom", "length")), "chrom") if "length" not in alignments.columns else described(alignments, spec)
    touching = spec.mask_mode == "fragments" and (blacklist is not None or whitelist is not None)
    if touching:
        # What a record touches depends on its place, strand and blocks alone.
        df = df.withColumn("row_id", F.struct("chrom", "pos", A.transcript_strand(F.col("flag"), spec.library if spec.library != "none" else "forward").alias("sign"), F.xxhash64("cigar").alias("cigar")))
        white = _touches(df, whitelist, spec).withColumn("w", F.lit(1)) if whitelist is not None else None
        black = _touches(df, blacklist, spec).withColumn("b", F.lit(2)) if blacklist is not None else None
        touch = F.lit(0)
        for part, name in ((white, "w"), (black, "b")):
            if part is not None:
                df = df.join(part, "row_id", "left")
                touch = touch + F.coalesce(name, F.lit(0))
        df = df.withColumn("touch", touch).drop("w", "b")
    else:
        df = df.withColumn("touch", F.lit(0))
    if spec.fragments or spec.model == "extend" or touching:
        df = with_mates(df, spec)
    else:
        none = F.lit(None)
        df = df.withColumn("mate_span", none.cast("bigint")).withColumn("mate_blocks", none.cast(A.BLOCK)).withColumn("mate_introns", none.cast(A.BLOCK)).withColumn("mate_touch", none.cast("int"))
    if touching:
        touch = F.col("touch").bitwiseOR(F.coalesce("mate_touch", F.lit(0)))
        df = df.filter(((touch.bitwiseAND(F.lit(1)) != 0) | F.lit(whitelist is None)) & (touch.bitwiseAND(F.lit(2)) == 0))
    return shaped(df, spec)


def bin_totals(counted: DataFrame, spec: Coverage) -> DataFrame:
    """Sum of covered bases, or of units, of each touched bin (chrom, length, lane, bin, total). Totals are integers: exact in any order.

    Coarse bins have a row for each bin that a unit touches. For fine ones, a run of whole bins is two changes of a running
    total, and bins are made only where the total isn't 0; so depth doesn't multiply rows.
    """
    iv = F.transform("iv", lambda b: F.struct(F.greatest(b["s"], F.lit(0)).cast("bigint").alias("s"), F.least(b["e"], F.col("length")).cast("bigint").alias("e")))
    df = counted.withColumn("iv", F.filter(iv, lambda b: b["e"] > b["s"]))
    return _changes(df, spec) if spec.bin_size < FINE else _touched(df, spec)


def _touched(df: DataFrame, spec: Coverage) -> DataFrame:
    w = spec.bin_size
    spread = lambda b: F.sequence(F.floor(b["s"] / w), F.floor((b["e"] - 1) / w))
    if spec.aggregation == "count":
        bins = df.select("chrom", "length", "lane", "weight", F.explode(F.array_distinct(F.flatten(F.transform("iv", spread)))).alias("bin"))
        total = F.sum("weight")
    else:
        bins = df.select("chrom", "length", "lane", "weight", F.explode("iv").alias("b")).select("chrom", "length", "lane", "weight", "b", F.explode(spread(F.col("b"))).alias("bin"))
        total = F.sum((F.least(F.col("b.e"), (F.col("bin") + 1) * w) - F.greatest(F.col("b.s"), F.col("bin") * w)) * F.col("weight"))
    return bins.groupBy("chrom", "length", "lane", "bin").agg(total.cast("long").alias("total"))


def _changes(df: DataFrame, spec: Coverage) -> DataFrame:
    w, per_tile = spec.bin_size, max(1, TILE_BASES // spec.bin_size)
    floor = lambda x, by: F.floor(x / by).cast("bigint")
    one = lambda at, own, change: F.struct(at.cast("bigint").alias("bin"), own.cast("bigint").alias("own"), change.cast("bigint").alias("change"))
    none, weight = F.lit(0), F.col("weight")

    def whole(first: Column, end: Column, each: Column) -> Column:
        """Changes of a run of bins [first, end) by `each`. The running total begins anew in each tile."""

        def part(t: Column) -> Column:
            return F.array(one(F.greatest(first, t * per_tile), none, each), one(F.least(end, (t + 1) * per_tile), none, -each))

        cut = F.flatten(F.transform(F.sequence(floor(first, per_tile), floor(end - 1, per_tile)), part))
        # A run that reaches a tile's end has no change there: the next tile knows nothing of it.
        return F.when(end > first, F.filter(cut, lambda c: (c["change"] > 0) | (c["bin"] % per_tile != 0))).otherwise(F.array().cast(CHANGES))

    if spec.aggregation == "count":
        runs = I.merged_array(F.transform("iv", lambda b: F.struct(floor(b["s"], w).alias("s"), (floor(b["e"] - 1, w) + 1).alias("e"))))
        changes = F.flatten(F.transform(runs, lambda r: whole(r["s"], r["e"], weight)))
    else:

        def of_block(b: Column) -> Column:
            first, last = floor(b["s"], w), floor(b["e"] - 1, w)
            head, tail = F.least(b["e"], (first + 1) * w) - b["s"], b["e"] - last * w
            edges = F.when(first == last, F.array(one(first, head * weight, none))).otherwise(F.array(one(first, head * weight, none), one(last, tail * weight, none)))
            return F.concat(edges.cast(CHANGES), whole(first + 1, last, weight * w))

        changes = F.flatten(F.transform("iv", of_block))
    lane = ["chrom", "length", "lane"]
    events = df.select(*lane, F.explode(changes).alias("c")).groupBy(*lane, "c.bin").agg(F.sum("c.own").alias("own"), F.sum("c.change").alias("change"))
    order = Window.partitionBy(*lane, "tile").orderBy("bin")
    events = events.withColumn("tile", floor(F.col("bin"), per_tile)).withColumn("run", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.coalesce(F.lead("bin").over(order), (F.col("tile") + 1) * per_tile)
    events = events.withColumn("after", after)
    bins = F.when(F.col("run") != 0, F.sequence("bin", F.col("after") - 1)).otherwise(F.array("bin"))
    out = events.select(*lane, "own", "run", F.col("bin").alias("at"), F.explode(bins).alias("bin"))
    total = F.col("run") + F.when(F.col("bin") == F.col("at"), F.col("own")).otherwise(0)
    return out.select(*lane, "bin", total.cast("long").alias("total")).filter("total <> 0")


def _mask_bins(regions: DataFrame, spec: Coverage) -> DataFrame:
    """(chrom, lane, bin) that a list touches."""
    w = spec.bin_size
    lanes = F.array(F.lit(0), F.lit(1)) if spec.strand == "split" or spec.mask_strand != "ignore" else F.array(F.lit(0))
    rows = regions.filter("end > start").select("chrom", "strand", F.explode(F.sequence(F.floor(F.col("start") / w), F.floor((F.col("end") - 1) / w))).alias("bin")).withColumn("lane", F.explode(lanes))
    if spec.mask_strand != "ignore":
        wanted = F.when((F.col("lane") == 0) == F.lit(spec.mask_strand == "sense"), "+").otherwise("-")
        rows = rows.filter((F.col("strand") == ".") | (F.col("strand") == wanted))
    return rows.select("chrom", "lane", "bin").distinct()


def denominator(alignments: DataFrame, chrom_sizes: DataFrame, spec: Coverage, blacklist=None, whitelist=None) -> float:
    """Reads or fragments behind CPM and RPKM: of the whole library (primary records), or of those that pass the filters."""
    rows = alignments.filter(~F.col("chrom").isin(*spec.ignored)) if spec.ignored else alignments
    if spec.denominator == "filtered":
        counted = units(rows, chrom_sizes, spec, blacklist, whitelist)
        # A pair of extended reads is placed once with weight 2, and counts as two reads.
        return float(counted.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    if not spec.fragments:
        # As an index counts: every mapped record.
        return float(rows.filter(~A.has(F.col("flag"), A.FLAGS["UNMAP"])).count())
    everything = Coverage(bin_size=spec.bin_size, aggregation="count", count_unit="fragment", model="plain")
    return float(units(rows, chrom_sizes, everything).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])


def binned(alignments: DataFrame, chrom_sizes: DataFrame, spec: Coverage, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Bins with signal: chrom, strand ('.', '+', '-'), bin, start, end, value (single precision)."""
    totals = bin_totals(units(alignments, chrom_sizes, spec, blacklist, whitelist), spec)
    if spec.mask_mode == "bins":
        if blacklist is not None:
            totals = totals.join(_mask_bins(blacklist, spec), ["chrom", "lane", "bin"], "left_anti")
        if whitelist is not None:
            totals = totals.join(_mask_bins(whitelist, spec), ["chrom", "lane", "bin"], "left_semi")
    if spec.strand != "split" and spec.mask_strand != "ignore":
        totals = totals.withColumn("lane", F.lit(0)).groupBy("chrom", "length", "lane", "bin").agg(F.sum("total").alias("total"))
    w = spec.bin_size
    bins = totals.filter("total <> 0").withColumn("start", F.col("bin") * w).withColumn("end", F.least((F.col("bin") + 1) * w, F.col("length")))
    factor = 1.0
    if spec.normalization in ("cpm", "rpkm"):
        found = denominator(alignments, chrom_sizes, spec, blacklist, whitelist)
        if not found:
            raise ValueError("nothing is left to normalize by")
        factor = (1e6 if spec.normalization == "cpm" else 1e9) / found
    elif spec.normalization == "bpm":
        placed = bins.filter(~F.col("chrom").isin(*spec.ignored)) if spec.ignored else bins
        found = placed.agg(F.sum("total")).first()[0]
        if not found:
            raise ValueError("nothing is left to normalize by")
        factor = 1e6 / found
    scale = F.when(F.col("lane") == 1, factor * (spec.scale if spec.scale_minus is None else spec.scale_minus)).otherwise(factor * spec.scale)
    width = (F.col("end") - F.col("start")).cast("double")
    value = F.col("total") * (scale / width if spec.normalization == "rpkm" else scale) if spec.aggregation != "mean" else F.col("total") / width * scale
    strand = F.when(F.col("lane") == 0, "+").otherwise("-") if spec.strand == "split" else F.lit(".")
    return bins.select("chrom", strand.alias("strand"), "bin", "start", "end", "length", narrow(value).alias("value"))


def _runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent intervals of equal value become one."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = (F.lag("end").over(w) == F.col("start")) & (F.lag("value").over(w) == F.col("value"))
    marked = df.withColumn("new", F.when(new, 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("run")


def run_length(bins: DataFrame, chrom_sizes: DataFrame, strands: tuple[str, ...] = (".",), zeros: bool = True) -> DataFrame:
    """Runs (chrom, strand, start, end, value) over whole chromosomes, zero runs included.

    Runs and the gaps between them are built within tiles; only the first and the last run of each tile, and a mark behind
    each chromosome's last base, are put in order across tiles.
    """
    tile, lane = ["chrom", "strand", "tile"], ["chrom", "strand"]
    tiled = bins.filter("value <> 0").withColumn("tile", F.floor(F.col("start") / TILE_BASES))
    runs = _runs(tiled.select(*tile, "start", "end", "value"), tile)
    inside = Window.partitionBy(*tile)
    runs = runs.withColumn("first", F.col("start") == F.min("start").over(inside)).withColumn("last", F.col("start") == F.max("start").over(inside))
    runs = runs.withColumn("before", F.lag("end").over(inside.orderBy("start")))
    zero = F.lit(0).cast("float")
    run = lambda start, end, value: F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), value.alias("value"))
    own = run(F.col("start"), F.col("end"), F.col("value"))
    gap = F.when(F.col("before") < F.col("start"), run(F.col("before"), F.col("start"), zero))
    inner = F.array(F.when(~F.col("first") & ~F.col("last"), own), *([gap] if zeros else []))
    edges = runs.filter(F.col("first") | F.col("last")).select(*lane, "first", "start", "end", "value")
    out = runs.select(*lane, F.explode(inner).alias("r")).filter("r is not null").select(*lane, "r.*")
    out = out.unionByName(_runs(edges.drop("first"), lane))
    if not zeros:
        return out
    whole = chrom_sizes.select("chrom", "length", F.explode(F.array(*[F.lit(s) for s in strands])).alias("strand"))
    marks = edges.unionByName(whole.select(*lane, F.lit(True).alias("first"), F.col("length").alias("start"), F.col("length").alias("end"), zero.alias("value")))
    before = F.coalesce(F.lag("end").over(Window.partitionBy(*lane).orderBy("start", "end")), F.lit(0))
    gaps = marks.withColumn("gap", before.cast("bigint")).filter(F.col("first") & (F.col("start") > F.col("gap")))
    return out.unionByName(gaps.select(*lane, F.col("gap").alias("start"), F.col("start").alias("end"), zero.alias("value")))


def coverage(alignments: DataFrame, chrom_sizes: DataFrame, spec: Coverage, blacklist: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Run-length encoded track of the alignments."""
    strands = ("+", "-") if spec.strand == "split" else (".",)
    return run_length(binned(alignments, chrom_sizes, spec, blacklist, whitelist), chrom_sizes, strands)


def reads_per_chromosome(alignments: DataFrame) -> DataFrame:
    """Mapped and unmapped records of each reference; unplaced ones under '*'."""
    unmapped = A.has(F.col("flag"), A.FLAGS["UNMAP"])
    return alignments.groupBy(F.coalesce("chrom", F.lit("*")).alias("chrom")).agg(F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped"))


def strandedness(alignments: DataFrame, probes: DataFrame) -> DataFrame:
    """Votes of templates in stranded probe regions: forward, reverse, share of forward and the verdict.

    A template counts once; one whose records disagree is dropped. All records are counted, not a sample.
    """
    rows = alignments.filter(~A.has(F.col("flag"), A.FLAGS["UNMAP"] | A.FLAGS["SECONDARY"] | A.FLAGS["SUPPLEMENTARY"]))
    spans = rows.select("qname", "flag", "chrom", F.col("pos").alias("start"), A.aligned_end(F.col("pos"), F.col("cigar")).alias("end"))
    hits = I.overlap_join(spans, probes.filter(F.col("strand").isin("+", "-")).select("chrom", "start", "end", "strand"))
    vote = F.when((A.transcript_strand(F.col("flag"), "forward") == 1) == (F.col("r_strand") == "+"), 1).otherwise(0)
    templates = hits.groupBy("qname").agg(F.min(vote).alias("low"), F.max(vote).alias("high")).filter("low = high")
    counted = templates.agg(F.count_if(F.col("low") == 1).alias("forward"), F.count_if(F.col("low") == 0).alias("reverse"))
    share = F.col("forward") / F.nullif(F.col("forward") + F.col("reverse"), F.lit(0))
    verdict = F.when(share >= 0.8, "forward").when(share <= 0.2, "reverse").otherwise("none")
    return counted.select("forward", "reverse", share.alias("share"), verdict.alias("library"))


def _at_rank(ordered: list[tuple[int, int]], rank: int) -> tuple[int, int]:
    """Of (value, times) in order: the value at a rank, and how many lie before it."""
    before = 0
    for v, n in ordered:
        if rank < before + n:
            return v, before
        before += n
    raise IndexError(rank)


def _median(counts: DataFrame) -> float | None:
    """Median of the present whole numbers v, each there n times; the driver holds the counts of VALUES numbers, or of blocks of as many."""
    some = counts.filter("v is not null")
    ordered = sorted((r["v"], r["n"]) for r in some.limit(VALUES + 1).collect())
    blocks = None
    if len(ordered) > VALUES:
        ordered = blocks = sorted((r["b"], r["n"]) for r in some.groupBy(F.floor(F.col("v") / VALUES).alias("b")).agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in ordered)
    if not total:
        return None
    found = []
    for rank in ((total - 1) // 2, total // 2):
        if blocks is not None:
            block, before = _at_rank(blocks, rank)
            ordered, rank = sorted((r["v"], r["n"]) for r in some.filter(F.floor(F.col("v") / VALUES) == block).collect()), rank - before
        found.append(_at_rank(ordered, rank)[0])
    return sum(found) / 2


def _median_of_least(rows: DataFrame, value: Column, sample: int) -> float | None:
    """Median of a value over the `sample` rows of least hash h, then name. Only lists of up to ORDERED rows are put in order at once."""
    rows = rows.select("h", "qname", value.cast("long").alias("v"))
    if sample <= ORDERED:
        return _median(rows.orderBy("h", "qname").limit(sample).groupBy("v").agg(F.count("*").alias("n")))
    if rows.count() <= sample:
        return _median(rows.groupBy("v").agg(F.count("*").alias("n")))
    # Whole parts of the hashes' range as far as they fit, then a share of the next part, in which equal rows are one.
    part = F.shiftright("h", 48)
    last, before = _at_rank(sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect()), sample)
    taken = rows.filter(part < last).groupBy("v").agg(F.count("*").alias("n"))
    edge = rows.filter(part == last).groupBy("h", "qname", "v").agg(F.count("*").alias("n"))
    passed = F.sum("n").over(Window.orderBy("h", "qname", "v")) - F.col("n")
    edge = edge.withColumn("n", F.least("n", F.lit(sample - before) - passed)).filter("n > 0").select("v", "n")
    return _median(taken.unionByName(edge).groupBy("v").agg(F.sum("n").alias("n")))


def typical_fragment(alignments: DataFrame, sample: int = 10_000) -> DataFrame:
    """Median |TLEN| of proper pairs, or median read length without any, of the records of least hash."""
    rows = described(alignments.filter(~A.has(F.col("flag"), A.FLAGS["UNMAP"])), Coverage()).withColumn("h", F.xxhash64("qname", "flag", "pos"))
    found = _median_of_least(rows.filter(F.col("proper") & (F.col("tlen") > 0)), F.col("tlen"), sample)
    if found is None:
        found = _median_of_least(rows, A.query_length(F.col("cigar")), sample)
    return alignments.sparkSession.createDataFrame([(found,)], "fragment_length double")
