"""BAM and bigWig: files made by hand, read in one and in several ranges, and written and read again."""

import random
import struct

from tracklake.sources import bam, bigwig


def record(name, flag, tid, pos, mapq, cigar, mtid, mpos, tlen, tags=b""):
    n = name.encode() + b"\0"
    ops = b"".join(struct.pack("<I", k << 4 | bam.OPS.index(op)) for op, k in cigar)
    seq = sum(k for op, k in cigar if op in "MIS=X")
    body = struct.pack("<iiBBHHHiiii", tid, pos, len(n), mapq, 0, len(cigar), flag, seq, mtid, mpos, tlen) + n + ops + bytes((seq + 1) // 2 + seq) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", 0, 0, i * 5, 60, [("M", 50), ("N", 10), ("M", 20)], -1, -1, 0, b"NMC\1RGZg1\0" if i % 2 else b"XBBc\2\0\0\0\1\2") for i in range(3000)]
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 50_000)
    path = str(tmp_path / "a.bam")
    with open(path, "wb") as f:
        f.write(bam.compress_blocks(head + b"".join(record(*r) for r in rows)))
    df, sizes = bam.read_bam(spark, path)
    found = df.orderBy("pos").collect()
    assert [(r.qname, r.pos, r.rg) for r in found] == [(f"r{i}", i * 5, "g1" if i % 2 else None) for i in range(3000)]
    assert tuple(sizes.first()) == ("c", 0, 50_000) and [tuple(c) for c in found[0].cigar] == [("M", 50), ("N", 10), ("M", 20)] and found[0].mchrom is None
    # An index that names every hundredth record makes several ranges.
    starts, blocks = [], bam.Blocks(path, bam.header(path)[1])
    for i in range(3000):
        if i % 100 == 0:
            starts.append(blocks.tell())
        blocks.read(struct.unpack("<i", blocks.read(4))[0])
    with open(path + ".bai", "wb") as f:
        chunks = b"".join(struct.pack("<QQ", v, v + 1) for v in starts)
        f.write(b"BAI\1" + struct.pack("<i", 1) + struct.pack("<i", 2) + struct.pack("<Ii", 5, len(starts)) + chunks + struct.pack("<Ii", 37450, 2) + struct.pack("<4Q", 0, 0, 3000, 7) + struct.pack("<i", 0))
    many, _ = bam.read_bam(spark, path, range_bytes=1)
    assert many.rdd.getNumPartitions() > 1 and sorted(r.pos for r in many.collect()) == [i * 5 for i in range(3000)]
    assert bam.index_counts(path) == [(3000, 7)] and rng is not None


def test_bigwig(spark, tmp_path):
    rng, rows = random.Random(2), []
    for chrom in ("chrB", "chrA"):
        at = 0
        for _ in range(3000):
            at += rng.randint(0, 3)
            n = rng.randint(1, 40)
            rows.append((chrom, at, at + n, rng.randint(-40, 40) / 4))
            at += n
    path = str(tmp_path / "a.bw")
    sizes = spark.createDataFrame([("chrB", 0, 200_000), ("chrA", 1, 200_000)], "chrom string, ord int, length long")
    bigwig.write_bigwig(spark.createDataFrame(rows, "chrom string, start long, end long, value double"), sizes, path)
    got = bigwig.read_bigwig(spark, path, blocks_per_task=2)
    assert sorted((r.chrom, r.start, r.end, r.value) for r in got.collect()) == sorted(rows)
    part = bigwig.read_bigwig(spark, path, chrom="chrA", start=1000, end=2000)
    assert sorted((r.start, r.end) for r in part.collect()) == sorted((s, e) for c, s, e, _ in rows if c == "chrA" and s < 2000 and e > 1000)
    assert {(r.chrom, r.length) for r in bigwig.chrom_sizes(spark, path).collect()} == {("chrA", 200_000), ("chrB", 200_000)}
    with open(path, "rb") as f:
        head = struct.unpack("<IHHQQQHHQQIQ", f.read(64))
        zooms = [struct.unpack("<IIQQ", f.read(24)) for _ in range(head[2])]
        f.seek(head[9])
        covered, low, high, total, _ = struct.unpack("<Qdddd", f.read(40))
    assert [z[0] for z in zooms] == [640, 2560, 10240, 40960] and covered == sum(e - s for _, s, e, _ in rows) and (low, high) == (min(r[3] for r in rows), max(r[3] for r in rows))
    assert abs(total - sum((e - s) * v for _, s, e, v in rows)) < 1e-6
    assert bigwig.read_bigwig(spark, path, chrom="none").count() == 0
