"""Count units and metrics of random templates against a model that paints bases one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.functions import alignments as A
from tracklake.operators import coverage as C

LENGTH, BIN, EXTEND, LEAST = 4000, 25, 170, 20
PAIRED, PROPER, BACK, MATE_BACK, FIRST, SECOND = 1, 2, 16, 32, 64, 128


class Mate:
    def __init__(self, start, pieces, back, good):
        """pieces: lengths in turn of aligned and skipped bases."""
        self.start, self.back, self.good, self.bases = start, back, good, []
        at = start
        for k, n in enumerate(pieces):
            if k % 2 == 0:
                self.bases += range(at, at + n)
            at += n
        self.end, self.cigar = at, "".join(f"{n}{'MN'[k % 2]}" for k, n in enumerate(pieces))


def templates(seed=5, n=90):
    """Lists of one or two mates: inward and dovetailed pairs, lone reads, spliced ones, some of low quality, some at the chromosome's ends."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pieces = lambda: [rng.randint(20, 60)] if rng.random() < 0.7 else [rng.randint(15, 30), rng.randint(5, 90), rng.randint(15, 30)]
        good = lambda: rng.random() < 0.8
        at, kind = rng.choice([0, rng.randint(0, 3700), rng.randint(3500, 3700)]), rng.random()
        if kind < 0.35:
            out.append([Mate(at, pieces(), rng.random() < 0.5, good())])
        elif kind < 0.75:
            left = Mate(at, pieces(), False, good())
            out.append([left, Mate(at + rng.randint(0, 150), pieces(), True, good())])
        else:
            left = Mate(at, pieces(), True, good())
            out.append([Mate(rng.randint(at + 1, left.end - 1), pieces(), False, good()), left])
    return [t for t in out if all(m.end <= LENGTH for m in t) and (len(t) == 1 or inward(t) or t[1].end > t[0].start)]


def inward(pair):
    return pair[0].start <= pair[1].start


def size(pair):
    """The pair's template length: from the forward mate's start to the reverse mate's end, or over both if they pass each other."""
    return pair[1].end - pair[0].start if inward(pair) else max(m.end for m in pair) - min(m.start for m in pair)


@pytest.fixture(scope="module")
def world(spark):
    rows, made = [], templates()
    for k, t in enumerate(made):
        for i, m in enumerate(t):
            other = t[1 - i] if len(t) == 2 else None
            flag = m.back * BACK + (PAIRED + PROPER + other.back * MATE_BACK + (FIRST, SECOND)[i] if other else 0)
            rows.append((f"t{k}", None, flag, "c", m.start, 60 if m.good else LEAST - 1, m.cigar, "c" if other else None, other.start if other else -1, (size(t) * (1, -1)[i]) if other else 0))
    df = spark.createDataFrame(rows, "qname string, rg string, flag int, chrom string, pos long, mapq int, cigar string, mchrom string, mpos long, tlen long")
    return df.withColumn("cigar", A.cigar_array(F.col("cigar"))).cache(), spark.createDataFrame([("c", 0, LENGTH)], "chrom string, ord int, length long"), made


def point(start, end, back, model):
    """The base that a span collapses to."""
    if model == "center":
        return [(start + end) // 2]
    return [end - 1] if back == (model == "5prime") else [start]


def painted(made, unit, model):
    """(bases, weight) of what is counted, by the rules of each unit and model."""
    out = []
    for t in made:
        kept = [m for m in t if m.good]
        facing = len(t) == 2 and inward(t)
        both = len(kept) == 2
        span = (t[0].start, t[0].start + size(t)) if facing else (min(m.start for m in t), max(m.end for m in t))
        # One unit for the whole template, or one for each mate that is left.
        whole = both and (unit == "fragment" or facing and model == "extend")
        if whole and model == "plain":
            out.append((set(kept[0].bases) | set(kept[1].bases), 1))
        elif whole and model == "extend":
            out.append((range(*span), 2 if unit == "read" else 1))
        elif whole:
            out.append((point(*span, False, model), 1))
        else:
            for m in kept:
                if model == "plain":
                    bases = m.bases
                elif model == "extend":
                    n = max(EXTEND, m.end - m.start)
                    bases = range(*span) if facing else range(m.end - n, m.end) if m.back else range(m.start, m.start + n)
                else:
                    bases = point(*span, False, model) if facing and unit == "fragment" else point(m.start, m.end, m.back, model)
                out.append((bases, 1))
    clipped = [(sorted(b for b in bases if 0 <= b < LENGTH), weight) for bases, weight in out]
    return [(bases, weight) for bases, weight in clipped if bases]


def spec_of(unit, model="plain", **other):
    return C.Coverage(bin_size=BIN, count_unit=unit, model=model, extend_length=EXTEND if model == "extend" else 0, min_mapq=LEAST, **{"aggregation": "count", **other})


@pytest.mark.parametrize("model", C.MODELS)
@pytest.mark.parametrize("unit", ["read", "fragment"])
def test_units(world, unit, model):
    df, sizes, made = world
    found = sorted((sorted({b for s, e in r.iv for b in range(s, e)}), r.weight) for r in C.units(df, sizes, spec_of(unit, model)).collect())
    assert found == sorted(painted(made, unit, model))


@pytest.mark.parametrize("unit", ["read", "fragment"])
@pytest.mark.parametrize("metric", ["mean", "sum", "count", "cpm", "filtered", "rpkm", "bpm"])
def test_metrics(world, unit, metric):
    df, sizes, made = world
    units = painted(made, unit, "plain")
    if metric in ("mean", "sum"):
        spec = spec_of(unit, aggregation=metric)
        want = [sum(b // BIN == k for bases, _ in units for b in bases) / (BIN if metric == "mean" else 1) for k in range(LENGTH // BIN)]
    else:
        spec = spec_of(unit, normalization={"count": "none", "filtered": "cpm"}.get(metric, metric), denominator="filtered" if metric == "filtered" else "library")
        counts = [sum(k in {b // BIN for b in bases} for bases, _ in units) for k in range(LENGTH // BIN)]
        library = len(units) if metric == "filtered" else len(made) if unit == "fragment" else sum(map(len, made))
        by = {"count": 1, "cpm": 1e6 / library, "filtered": 1e6 / library, "rpkm": 1e9 / library / BIN, "bpm": 1e6 / sum(counts)}[metric]
        want = [c * by for c in counts]
    got = np.full(LENGTH, -1.0)
    for r in C.coverage(df, sizes, spec).collect():
        assert (got[r.start : r.end] == -1).all()
        got[r.start : r.end] = r.value
    np.testing.assert_allclose(got, np.repeat(want, BIN), rtol=1e-6)


def test_blocks_and_flags(spark):
    df = spark.createDataFrame([("10S20M10N10M10S",), ("5M2I5M3D4=",), ("*",)], "c string").select(A.cigar_array(F.col("c")).alias("c"))
    rows = df.select(A.blocks(F.lit(100), F.col("c")).alias("b"), A.introns(F.lit(100), F.col("c")).alias("i"), A.aligned_end(F.lit(100), F.col("c")).alias("e"), A.query_length(F.col("c")).alias("q")).collect()
    assert [[tuple(b) for b in r.b] for r in rows] == [[(100, 120), (130, 140)], [(100, 110), (113, 117)], []]
    assert [tuple(b) for b in rows[0].i] == [(120, 130)]
    assert [r.e for r in rows] == [140, 117, 101] and [r.q for r in rows] == [50, 16, 0]
    assert A.flag_pattern("PAIRED,^0x10") == (1, 16) and A.flag_mask("DUP,256") == 0x500
    assert A.flag_pattern("^ dup, 2") == (2, 0x400) and A.flag_pattern("^1,^2") == (0, 3)
    for wrong in ("PAIRED,^PAIRED", "^^PAIRED", "", "PAIRED,", "0x", "0x1_0", "65536", "-1", "NONE"):
        with pytest.raises(ValueError):
            A.flag_pattern(wrong)
    with pytest.raises(ValueError):
        A.flag_mask("^DUP")


@pytest.mark.parametrize("aggregation", ["count", "sum", "mean"])
@pytest.mark.parametrize("unit", ["read", "fragment"])
def test_fine_bins_by_changes(world, unit, aggregation, monkeypatch):
    """Totals from changes of a running total are those of painting, for bins of any size and over many tiles; so are the runs."""
    df, sizes, made = world
    monkeypatch.setattr(C, "TILE_BASES", 64)
    for size in (1, 7, 24):
        spec = C.Coverage(bin_size=size, count_unit=unit, min_mapq=LEAST, aggregation=aggregation)
        want = np.zeros(-(-LENGTH // size))
        for bases, weight in painted(made, unit, "plain"):
            for k in {b // size for b in bases} if aggregation == "count" else (b // size for b in bases):
                want[k] += weight
        if aggregation == "mean":
            want /= [min(size, LENGTH - k * size) for k in range(len(want))]
        runs = C.coverage(df, sizes, spec).orderBy("start").collect()
        got = np.concatenate([np.full(r.end - r.start, r.value) for r in runs])
        assert runs[0].start == 0 and all(a.end == b.start and a.value != b.value for a, b in zip(runs, runs[1:]))
        np.testing.assert_allclose(got, np.repeat(want, size)[:LENGTH], rtol=1e-6)


def test_masks(world, spark):
    df, sizes, made = world
    masked = set(range(700, 760)) | set(range(2100, 2110))
    black = spark.createDataFrame([("c", 700, 760, "."), ("c", 2100, 2110, ".")], "chrom string, start long, end long, strand string")
    count = lambda units: {k: n for k in range(LENGTH // BIN) if (n := sum(any(b // BIN == k for b in bases) for bases, _ in units))}
    found = lambda spec, **lists: {r.bin: r.value for r in C.binned(df, sizes, spec, **lists).collect()}
    touched, plain = {b // BIN for b in masked}, count(painted(made, "read", "plain"))
    assert found(spec_of("read"), blacklist=black) == {k: n for k, n in plain.items() if k not in touched}
    assert found(spec_of("read"), whitelist=black) == {k: n for k, n in plain.items() if k in touched}
    # A template goes as a whole if a retained mate's blocks touch the list.
    hit = lambda t: any(m.good and masked & set(m.bases) for m in t)
    whole = spec_of("fragment", mask_mode="fragments")
    assert found(whole, blacklist=black) == count(painted([t for t in made if not hit(t)], "fragment", "plain"))
    assert found(whole, whitelist=black) == count(painted([t for t in made if hit(t)], "fragment", "plain"))


def test_typical_fragment_orders_few_rows(spark, monkeypatch):
    """Any sample has the median of a sort by hash and name; a sample larger than all rows puts nothing in order."""
    rng = random.Random(8)
    lengths = [rng.choice([rng.randint(60, 90), rng.randint(60, 2000)]) for _ in range(300)]
    rows = [(f"q{i // 2}", None, 99, "c", 7 * (i // 2), 60, [("M", 50)], "c", 7 * (i // 2) + n - 50, n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "qname string, rg string, flag int, chrom string, pos long, mapq int, cigar array<struct<op:string,len:int>>, mchrom string, mpos long, tlen long")
    hashed = sorted((r.h, r.qname, r.tlen) for r in df.select(F.xxhash64("qname", "flag", "pos").alias("h"), "qname", "tlen").collect())
    median = lambda k: float(np.median([t for _, _, t in hashed[:k]]))
    typical = lambda k: C.typical_fragment(df, k).first().fragment_length
    assert [typical(k) for k in (20, 1000)] == [median(k) for k in (20, 1000)]
    monkeypatch.setattr(C, "ORDERED", 0)
    for values in (1 << 16, 16):  # few values at once, or blocks of them
        monkeypatch.setattr(C, "VALUES", values)
        assert [typical(k) for k in (1, 20, 151, 300, 1 << 30)] == [median(k) for k in (1, 20, 151, 300, 1 << 30)]
    single = df.withColumn("mchrom", F.lit(None).cast("string"))
    assert C.typical_fragment(single, 1 << 30).first().fragment_length == 50.0 and C.typical_fragment(single.limit(0)).first().fragment_length is None
    monkeypatch.undo()
    monkeypatch.setattr(type(df), "orderBy", None)  # not for a sample that has all rows
    assert typical(1 << 30) == median(300)
