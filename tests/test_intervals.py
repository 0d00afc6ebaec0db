"""Interval algebra against sets of bases, over tiles of any size."""

import random

import pytest

from tracklake.operators import intervals as I


def runs(bases):
    """Maximal runs of (key, base)."""
    out = []
    for key, p in sorted(bases):
        if out and out[-1][0] == key and out[-1][2] == p:
            out[-1] = (key, out[-1][1], p + 1)
        else:
            out.append((key, p, p + 1))
    return out


@pytest.mark.parametrize("tile", [16, 1 << 20])
def test_algebra(spark, tile, monkeypatch):
    monkeypatch.setattr(I, "TILE", tile)
    rng = random.Random(tile)

    def some(n):
        out = []
        for _ in range(n):
            s = rng.randint(-20, 400)
            out.append((rng.choice("ab"), s, s + rng.choice([-3, 0, 1, 5, 16, 40, 90])))
        return out

    a, b = some(40), some(25)
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "chrom string, start long, end long, name string")
    bases = lambda rows: {(c, p) for c, s, e in rows for p in range(s, e)}
    found = lambda df: sorted((r.chrom, r.start, r.end) for r in df.collect())
    assert found(I.merge(frame(a))) == runs(bases(a))
    assert found(I.subtract(frame(a), frame(b))) == runs(bases(a) - bases(b))
    assert found(I.intersect(frame(a), frame(b))) == runs(bases(a) & bases(b))
    assert I.merge(frame(a).filter("start > 9999")).count() == 0
