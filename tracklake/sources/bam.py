"""BAM files: compressed blocks split at the places that the index knows as record starts.

The driver reads the header and the index and makes ranges of virtual offsets; tasks read their own range. Without an
index a file is one range. Paths are read with open(): on a cluster, a file system that is mounted on all nodes.
"""

from __future__ import annotations

import gzip
import os
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracklake.shipping import ship_code

RANGE_BYTES = 32 << 20
SCHEMA = "qname string, rg string, flag int, chrom string, pos long, mapq int, cigar array<struct<op:string,len:int>>, mchrom string, mpos long, tlen long"
CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
ARROW = pa.schema([("qname", pa.string()), ("rg", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", CIGAR), ("mchrom", pa.string()), ("mpos", pa.int64()), ("tlen", pa.int64())])
#: Operations by number; sizes of typed tag values.
OPS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


class Blocks:
    """Decompressed bytes of a file of blocks from a virtual offset (block place << 16 | offset in the block)."""

    def __init__(self, path: str, at: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(at >> 16)
        self.place, self.data, self.next = at >> 16, b"", at >> 16
        self._load()
        self.used = at & 0xFFFF

    def _load(self) -> bool:
        while True:
            self.place = self.next
            head = self.file.read(18)
            if len(head) < 18:
                self.data, self.used = b"", 0
                return False
            extra = struct.unpack("<H", head[10:12])[0]
            size = struct.unpack("<H", head[16:18])[0] + 1
            body = self.file.read(size - 18)
            self.next = self.place + size
            self.data, self.used = zlib.decompress(body[extra - 6 : -8], -15), 0
            if self.data:
                return True

    def tell(self) -> int:
        if self.used >= len(self.data) and not self._load():
            return 1 << 62
        return self.place << 16 | self.used

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.used >= len(self.data) and not self._load():
                break
            part = self.data[self.used : self.used + n - len(out)]
            self.used += len(part)
            out += part
        return out

    def close(self):
        self.file.close()


def header(path: str) -> tuple[list[tuple[str, int]], int]:
    """Reference names and lengths, and the virtual offset of the first record."""
    blocks = Blocks(path)
    if blocks.read(4) != b"BAM\1":
        raise ValueError(f"{path} is no BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    first = blocks.tell()
    blocks.close()
    return refs, first


def index_starts(path: str) -> list[int]:
    """Virtual offsets of records that a .bai index names."""
    found = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if os.path.exists(p)), None)
    if not found:
        return []
    with open(found, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{found} is no BAI index")
    at, out = 8, set()
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if number != 37450:  # the last one holds counts, no places
                out.update(struct.unpack_from(f"<{2 * chunks}Q", data, at)[::2])
            at += 16 * chunks
        windows = struct.unpack_from("<i", data, at)[0]
        out.update(v for v in struct.unpack_from(f"<{windows}Q", data, at + 4) if v)
        at += 4 + 8 * windows
    return sorted(out)


def index_counts(path: str) -> list[tuple[int, int]]:
    """(mapped, unmapped) of each reference, as the index says."""
    with open(path + ".bai", "rb") as f:
        data = f.read()
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins, seen = struct.unpack_from("<i", data, at)[0], (0, 0)
        at += 4
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            if number == 37450 and chunks >= 2:
                seen = struct.unpack_from("<2Q", data, at + 16)
            at += 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
        out.append(seen)
    return out


def ranges(path: str, first: int, size: int = RANGE_BYTES) -> list[tuple[int, int]]:
    cuts = [first]
    for v in index_starts(path):
        if (v >> 16) - (cuts[-1] >> 16) >= size:
            cuts.append(v)
    return list(zip(cuts, [*cuts[1:], 1 << 62]))


def read_group(tags: bytes) -> str | None:
    at = 0
    while at + 3 <= len(tags):
        name, kind, at = tags[at : at + 2], chr(tags[at + 2]), at + 3
        if kind in "ZH":
            end = tags.index(0, at)
            if name == b"RG":
                return tags[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += TAG_SIZES[kind]
    return None


def records(path: str, begin: int, end: int, names: list[str]):
    blocks = Blocks(path, begin)
    try:
        while blocks.tell() < end:
            size = blocks.read(4)
            if len(size) < 4:
                return
            r = blocks.read(struct.unpack("<i", size)[0])
            tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", r)
            at = 32 + l_name
            ops = struct.unpack_from(f"<{n_cigar}I", r, at)
            at += 4 * n_cigar + (l_seq + 1) // 2 + l_seq
            name = lambda i: names[i] if i >= 0 else None
            yield (r[32 : 31 + l_name].decode(), read_group(r[at:]), flag, name(tid), pos, mapq, [{"op": OPS[c & 15], "len": c >> 4} for c in ops], name(mtid), mpos, tlen)
    finally:
        blocks.close()


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(alignments, chromosome sizes)."""
    ship_code(spark)
    refs, first = header(path)
    names = [n for n, _ in refs]

    def run(batches):
        for batch in batches:
            for begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                out = []
                for r in records(path, begin, end, names):
                    out.append(r)
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)

    parts = ranges(path, first, range_bytes)
    plan = spark.createDataFrame(parts, "begin long, stop long").repartition(len(parts))
    sizes = spark.createDataFrame([(n, i, size) for i, (n, size) in enumerate(refs)], "chrom string, ord int, length long")
    return plan.mapInArrow(run, SCHEMA), sizes


def compress_blocks(data: bytes) -> bytes:
    """Bytes as blocks with the closing empty one (for tests and small files)."""
    out = b""
    for i in range(0, len(data), 60_000):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[i : i + 60_000]
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    assert not data or gzip.decompress(out) == data
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
