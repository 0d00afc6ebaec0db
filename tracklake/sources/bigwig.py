"""bigWig files: read by the blocks of their index, written from blocks that executors compress.

Reading: the driver walks the index to the leaves and deals the blocks; tasks decompress their own. Writing: tasks sort,
cut and compress; the driver only appends finished blocks in order, then writes the index and the zoom levels, whose
summaries are aggregated by Spark. Paths are read and written with open(): on a cluster, a mounted file system.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.functions.missing import finite
from tracklake.shipping import ship_code

MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
PER_BLOCK, FANOUT = 1024, 256


def _chromosomes(f, at: int) -> list[tuple[str, int, int]]:
    """(name, id, length) of the name tree."""
    f.seek(at)
    magic, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.read(32))
    if magic != TREE:
        raise ValueError("broken chromosome tree")
    out, todo = [], [at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack("<BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                out.append((name, *struct.unpack("<II", f.read(8))))
            else:
                todo.append(struct.unpack("<Q", f.read(8))[0])
    return sorted(out, key=lambda c: c[1])


def _leaves(f, at: int, wanted: tuple[int, int, int] | None) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks, or of those that overlap (chromosome, start, end)."""
    f.seek(at)
    if struct.unpack("<I", f.read(4))[0] != INDEX:
        raise ValueError("broken data index")
    out, todo = [], [at + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack("<BBH", f.read(4))
        data = f.read(n * (32 if leaf else 24))
        for i in range(n):
            c0, s, c1, e, place, *size = struct.unpack_from("<IIIIQQ" if leaf else "<IIIIQ", data, i * (32 if leaf else 24))
            if wanted and not ((c0, s) < (wanted[0], wanted[2]) and (c1, e) > (wanted[0], wanted[1])):
                continue
            if leaf:
                out.append((place, size[0]))
            else:
                todo.append(place)
    return sorted(out)


def _head(path: str):
    f = open(path, "rb")  # noqa: SIM115
    magic, _, _, tree, _, index, _, _, _, _, buffer, _ = struct.unpack("<IHHQQQHHQQIQ", f.read(64))
    if magic != MAGIC:
        raise ValueError(f"{path} is no bigWig file")
    return f, tree, index, buffer > 0


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    f, tree, _, _ = _head(path)
    with f:
        rows = [(name, i, length) for name, i, length in _chromosomes(f, tree)]
    return spark.createDataFrame(rows, "chrom string, ord int, length long")


def _decoded(data: bytes):
    """(chromosome id, start, end, value) of a block."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", data)
    if kind == 1:
        for s, e, v in struct.iter_unpack("<IIf", data[24 : 24 + 12 * n]):
            yield chrom, s, e, v
    elif kind == 2:
        for s, v in struct.iter_unpack("<If", data[24 : 24 + 8 * n]):
            yield chrom, s, s + span, v
    else:
        for i, (v,) in enumerate(struct.iter_unpack("<f", data[24 : 24 + 4 * n])):
            yield chrom, start + i * step, start + i * step + span, v


def read_bigwig(spark: SparkSession, path: str, sample: int = 0, chrom: str | None = None, start: int = 0, end: int = 1 << 32, blocks_per_task: int = 512) -> DataFrame:
    """sample, source, chrom, start, end, value; with chrom, only the blocks that the index finds for that span are read."""
    ship_code(spark)
    f, tree, index, packed = _head(path)
    with f:
        names = {i: name for name, i, _ in _chromosomes(f, tree)}
        by_name = {name: i for i, name in names.items()}
        wanted = (by_name.get(chrom, -1), start, end) if chrom else None
        blocks = _leaves(f, index, wanted) if not chrom or chrom in by_name else []

    def run(batches):
        with open(path, "rb") as f:
            for batch in batches:
                for place, size in zip(*(c.to_pylist() for c in batch.columns)):
                    f.seek(place)
                    data = f.read(size)
                    rows = [(names[c], s, e, v) for c, s, e, v in _decoded(zlib.decompress(data) if packed else data)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float32()))], ["chrom", "start", "end", "value"])

    plan = spark.createDataFrame(blocks, "place long, size long").repartitionByRange(max(1, -(-len(blocks) // blocks_per_task)), "place")
    rows = plan.mapInArrow(run, "chrom string, start long, end long, value float")
    if chrom:
        rows = rows.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    return rows.select(F.lit(sample).alias("sample"), F.lit(sample).alias("source"), "chrom", "start", "end", finite(F.col("value")).cast("float").alias("value")).filter("value is not null")


def _blocks(track: DataFrame, kind: str) -> DataFrame:
    """Compressed blocks of rows in order: chromosome id and bounds of each, and the payload."""

    def run(batches):
        rows: list[tuple] = []

        def cut():
            body = b"".join(struct.pack("<IIf", r[1], r[2], r[3]) if kind == "data" else struct.pack("<IIIIffff", *r) for r in rows)
            head = struct.pack("<IIIIIBBH", rows[0][0], rows[0][1], rows[-1][2], 0, 0, 1, 0, len(rows)) if kind == "data" else b""
            out = (rows[0][0], rows[0][1], rows[-1][2], zlib.compress(head + body), len(head + body))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["c", "s", "e", "body", "raw"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (r[0] != rows[0][0] or len(rows) == PER_BLOCK):
                    yield cut()
                rows.append(r)
        if rows:
            yield cut()

    return track.mapInArrow(run, "c long, s long, e long, body binary, raw long")


def _index(blocks: list[tuple[int, int, int, int, int]], at: int, end: int) -> bytes:
    """R tree over (chromosome, start, end, place, size), written from `at` on."""
    levels = [[(c, s, c, e, place, size) for c, s, e, place, size in blocks]]
    while len(levels[-1]) > FANOUT or len(levels) == 1 and not levels[-1]:
        below = levels[-1]
        levels.append([(g[0][0], g[0][1], *max((x[2], x[3]) for x in g), i, 0) for i, g in enumerate(below[k : k + FANOUT] for k in range(0, len(below), FANOUT))])
        if not below:
            break
    nodes = [[lv[k : k + FANOUT] for k in range(0, len(lv), FANOUT)] or [[]] for lv in levels][::-1]
    size = lambda node, leaf: 4 + len(node) * (32 if leaf else 24)
    places, here = [], at + 48
    for depth, level in enumerate(nodes):
        row = []
        for node in level:
            row.append(here)
            here += size(node, depth == len(nodes) - 1)
        places.append(row)
    first = levels[0]
    bounds = (first[0][0], first[0][1], first[-1][2], max((b[3] for b in first if b[2] == first[-1][2]), default=0)) if first else (0, 0, 0, 0)
    out = [struct.pack("<IIQIIIIQII", INDEX, FANOUT, len(first), *bounds, end, 1, 0)]
    for depth, level in enumerate(nodes):
        leaf = depth == len(nodes) - 1
        child = 0
        for node in level:
            out.append(struct.pack("<BBH", leaf, 0, len(node)))
            for c0, s, c1, e, place, n in node:
                out.append(struct.pack("<IIIIQQ", c0, s, c1, e, place, n) if leaf else struct.pack("<IIIIQ", c0, s, c1, e, places[depth + 1][child]))
                child += 1
    return b"".join(out)


def write_bigwig(track: DataFrame, sizes: DataFrame, path: str, first_zoom: int = 640, zooms: int = 4) -> None:
    """chrom, start, end, value (disjoint) to a bigWig file with zoom levels of count, min, max, sum and sum of squares."""
    spark = track.sparkSession
    ship_code(spark)
    # A line for each chromosome.
    names = [(r["chrom"], r["length"]) for r in sizes.orderBy("chrom").collect()]
    ids = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(names)], "chrom string, c long")
    rows = track.join(F.broadcast(ids), "chrom").select("c", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("value").cast("float").alias("v")).filter("v is not null and e > s")
    v, w = F.col("v").cast("double"), F.col("w").cast("double")
    levels, width = [], first_zoom
    for _ in range(zooms):
        each = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))).withColumn("w", F.least("e", (F.col("b") + 1) * width) - F.greatest("s", F.col("b") * width))
        zoomed = each.groupBy("c", "b").agg(F.min(F.greatest("s", F.col("b") * width)).alias("zs"), F.max(F.least("e", (F.col("b") + 1) * width)).alias("ze"), F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(v * w).alias("t"), F.sum(v * v * w).alias("q"))
        levels.append((width, zoomed.select("c", "zs", "ze", F.col("n").cast("long"), "lo", "hi", F.col("t").cast("float"), F.col("q").cast("float")).orderBy("c", "zs")))
        width *= 4
    total = rows.withColumn("w", F.col("e") - F.col("s")).agg(F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.min("v"), F.lit(0.0)), F.coalesce(F.max("v"), F.lit(0.0)), F.coalesce(F.sum(v * w), F.lit(0.0)), F.coalesce(F.sum(v * v * w), F.lit(0.0))).first()
    key = max([1, *(len(n.encode()) for n, _ in names)])
    most = 0
    with open(path, "wb") as f:
        f.write(bytes(64 + 24 * zooms))
        summary = f.tell()
        f.write(struct.pack("<Qdddd", int(total[0]), *map(float, total[1:])))
        tree = f.tell()
        f.write(struct.pack("<IIIIQQ", TREE, max(1, len(names)), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)))
        for i, (n, size) in enumerate(names):
            f.write(n.encode().ljust(key, b"\0") + struct.pack("<II", i, size))
        data = f.tell()
        f.write(bytes(8))
        places = []
        for kind, df, zoom in [("data", rows.orderBy("c", "s"), 0), *(("zoom", z, width) for width, z in levels)]:
            begin, blocks = f.tell(), []
            if zoom:
                f.write(bytes(4))
            # Blocks come one partition at a time, in order; the driver holds their index entries.
            for r in _blocks(df, kind).toLocalIterator(prefetchPartitions=True):
                blocks.append((r["c"], r["s"], r["e"], f.tell(), len(r["body"])))
                most = max(most, r["raw"])
                f.write(r["body"])
            at = f.tell()
            f.write(_index(blocks, at, at))
            places.append((zoom, begin, at, len(blocks)))
        f.write(struct.pack("<I", MAGIC))
        f.seek(data)
        f.write(struct.pack("<Q", places[0][3]))
        for zoom, begin, _, n in places[1:]:
            f.seek(begin)
            f.write(struct.pack("<I", n))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, zooms, tree, data, places[0][2], 0, 0, 0, summary, max(most, 1), 0))
        for zoom, begin, at, _ in places[1:]:
            f.write(struct.pack("<IIQQ", zoom, 0, begin, at))
