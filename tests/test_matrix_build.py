"""Matrices against a base-by-base computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import matrix_build as M

SIZE = 3000


def brute(blocks, minus, layout, signal, statistic, as_zero, hidden):
    found = M.plan(blocks, minus, layout)
    if found is None:
        return None
    zones, pad, _ = found
    out = [np.nan] * pad
    for parts, n in zones:
        values = []
        for s, e in parts:
            for p in range(s, e):
                v = signal[p] if 0 <= p < SIZE else np.nan
                v = 0.0 if as_zero and np.isnan(v) else v
                values.append(np.nan if p in hidden else v)
        length = len(values)
        for i in range(n):
            if not length:
                out.append(np.nan)
                continue
            b = i * length // n
            part = np.array(values[b : min(length, max(b + 1, (i + 1) * length // n))])
            part = part[~np.isnan(part)]
            out.append({"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "median": np.median}[statistic](part) if len(part) else np.nan)
    out += [np.nan] * (layout.bins - len(out))
    return out[::-1] if minus else out


LAYOUTS = [
    M.Layout(upstream=50, downstream=80, bin_size=10), M.Layout(upstream=50, downstream=80, bin_size=10, anchor="tes"), M.Layout(upstream=60, downstream=40, bin_size=10, anchor="center"),
    M.Layout(upstream=50, downstream=300, bin_size=10, stop_at_end=True), M.Layout(upstream=30, downstream=20, body=100, unscaled5=20, unscaled3=10, bin_size=10), M.Layout(body=400, bin_size=10),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_matrix(spark, k):
    layout, rng = LAYOUTS[k], random.Random(k)
    statistic, as_zero = ["mean", "sum", "median", "max", "min", "median"][k], k % 2 == 1
    signal, track, at = np.full(SIZE, np.nan), [], 0
    while at < SIZE - 60:
        n = rng.randint(3, 40)
        if rng.random() < 0.7:
            v = float(rng.randint(-5, 9))
            track.append((0, "c", at, at + n, v))
            signal[at : at + n] = v
        at += n
    regions = []
    for r in range(40):
        s, blocks = rng.randint(0, SIZE - 400), []
        for _ in range(rng.randint(1, 3)):
            e = s + rng.randint(15, 90)
            blocks.append((s, e))
            s = e + rng.randint(5, 40)
        regions.append((r, 0, r, "c", [{"start": a, "end": b} for a, b in blocks], rng.choice("+-.")))
    mask = [("c", 500, 620), ("c", 1500, 1507)]
    hidden = {p for _, a, b in mask for p in range(a, b)}
    df = spark.createDataFrame(regions, "row_id long, group_id int, ord long, chrom string, blocks array<struct<start:bigint,end:bigint>>, strand string")
    out = M.build(df, spark.createDataFrame(track, "source int, chrom string, start long, end long, value double"), spark.createDataFrame([("c", SIZE)], "chrom string, length long"), layout, statistic, as_zero, mask=spark.createDataFrame(mask, "chrom string, start long, end long"))
    got = {r.row_id: [np.nan if v is None else v for v in r.bins] for r in out.collect()}
    want = {r[0]: brute([(b["start"], b["end"]) for b in r[4]], r[5] == "-", layout, signal, statistic, as_zero, hidden) for r in regions}
    assert set(got) == {i for i, w in want.items() if w is not None}
    for i, row in got.items():
        np.testing.assert_allclose(row, want[i], rtol=1e-6, err_msg=str(regions[i]))


def test_strands(spark):
    df = spark.createDataFrame([(i, 0, i, "c", [{"start": 100, "end": 120}], s) for i, s in enumerate("+-.")], "row_id long, group_id int, ord long, chrom string, blocks array<struct<start:bigint,end:bigint>>, strand string")
    track = spark.createDataFrame([(0, "c", 0, 110, 1.0), (1, "c", 0, 200, 10.0)], "source int, chrom string, start long, end long, value double")
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, length long")
    layout = M.Layout(body=20, bin_size=10)
    rows = M.build(df, track, sizes, layout, wanted=M.sources(df, 1, stranded=True, antisense=True, scale_antisense=-1.0), tracks_count=2).collect()
    assert {(r.row_id, r.sample): r.bins for r in rows} == {
        (0, 0): [1.0, None], (0, 1): [-10.0, -10.0], (1, 0): [10.0, 10.0], (1, 1): [None, -1.0], (2, 0): [11.0, None], (2, 1): [-11.0, None],
    }


def test_antisense_groups(spark):
    """Each region's copy reads the other strand in a group of its own; bins and orientation stay."""
    df = spark.createDataFrame([(0, 0, 0, "c", [{"start": 100, "end": 120}], "-", "x")], "row_id long, group_id int, ord long, chrom string, blocks array<struct<start:bigint,end:bigint>>, strand string, name string")
    both = M.with_antisense_groups(df)
    track = spark.createDataFrame([(0, "c", 0, 110, 1.0), (1, "c", 0, 200, 10.0)], "source int, chrom string, start long, end long, value double")
    rows = M.build(both, track, spark.createDataFrame([("c", 1000)], "chrom string, length long"), M.Layout(body=20, bin_size=10), wanted=M.sources(both, 1, stranded=True, scale_antisense=2.0), tracks_count=2).collect()
    assert {(r.group_id, r.row_id): r.bins for r in rows} == {(0, 0): [10.0, 10.0], (1, 1): [None, 2.0]} and {r.name for r in both.collect()} == {"x", "x_antisense"}


def test_plan_properties():
    rng = random.Random(5)
    for _ in range(250):
        s, blocks = rng.randint(0, 500), []
        for _ in range(rng.randint(1, 4)):
            e = s + rng.randint(1, 84)
            blocks.append((s, e))
            s = e + rng.randint(1, 30)
        w = rng.randint(1, 9)
        layout = M.Layout(upstream=w * rng.randint(0, 6), downstream=w * rng.randint(1, 9), bin_size=w, anchor=rng.choice(M.ANCHORS), stop_at_end=rng.random() < 0.5)
        zones, left, right = M.plan(blocks, rng.random() < 0.5, layout)
        assert left + sum(n for _, n in zones) + right <= layout.bins + 2
    assert F is not None
