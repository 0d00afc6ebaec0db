"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts in a document with a smaller id.

Sorting every suffix of a corpus would move fifty times its size, so the suffix array is sparse, without losing matches:
in each window of SPAN bytes the GRAM bytes of least hash are its anchor. Equal windows have equal anchors at equal
places, so it is enough to sort the suffixes that begin at anchors, with the bytes before them that their windows reach.

1. Documents are written as blocks of about BLOCK_BYTES; each block sends the hashes of its anchors, and learns which
   ones occur in another document (a prefilter: a false answer costs work, not correctness) and which are hot.
2. For those, each block sends each distinct anchored suffix once, with its least document: copies and hot passages are
   pre-aggregated here. Splitters sampled from the anchors range-partition the suffixes by their leading bytes, into RANGES
   ranges at most; of a larger corpus, each range is cut further by a hash of the anchor.
3. A bucket sorts its suffixes by multikey quicksort on 8-byte words. Equal neighbours give the least document of whole
   suffixes; where suffixes of one anchor differ, their windows are sorted in the same way. Splitters are whole anchors,
   so suffixes of one anchor never lie on both sides of a boundary, and each block's own runs are compared with those of
   all other blocks in one place.
4. Each block gets back the least documents and marks the covered bytes.

An anchor that more than HOT places hold, such as a phrase with very many surroundings, would put all of these in one
bucket. Its windows are sent instead, each distinct one once, to buckets by a hash of all their bytes.

Blocks are read three times, from a table bucketed by block, so that texts are never shuffled. A block writes rows for the
buckets in which it has something; a task knows RANGES splitters and nothing that grows with the corpus.

Edge cases: null and empty texts have no bytes; texts shorter than SPAN lose nothing and no match crosses documents;
equal ids are the same document to each other; rows of a null doc_id are no source and lose nothing; repeated rows stay;
a text of one repeated byte has as many runs as bytes, of which each distinct one is kept.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, mapped, materialize, shared_dir, ship_code

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM  # bytes of a window before or after its anchor, at most
BLOCK_BYTES = 4 << 20
#: Text bytes for each bucket of hashes and of suffixes.
HASH_BUCKET_BYTES = 8 << 20
SUFFIX_BUCKET_BYTES = 4 << 20
#: Blocks sampled for the splitters, and anchors of each, at most; ranges that the splitters make, at most.
SAMPLE_BLOCKS, SAMPLE_ANCHORS, RANGES = 64, 1024, 4096
#: Places of an anchor, counted up to 255 for each block, from which on it is hot.
HOT = 32_768
#: Rows that are made before equal ones become one.
CHUNK = 1 << 16
NOBODY = np.iinfo(np.int64).max

M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def gram_hashes(text: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the GRAM bytes from each position (or from the given ones)."""
    n = len(text) - GRAM + 1
    # Eight bytes from each position on, without copies.
    eight = np.ndarray((n + GRAM - 8,), np.uint64, buffer=text, strides=(1,))
    a, b, c = (eight[:n], eight[8 : n + 8], eight[16 : n + 16]) if at is None else (eight[at], eight[at + 8], eight[at + 16])
    h = a * M1
    h += b * M2
    h ^= h >> np.uint64(29)
    h *= M3
    h += c * M4
    h ^= h >> np.uint64(32)
    h *= M2
    h ^= h >> np.uint64(31)
    return h


def anchored(text: np.ndarray, starts: np.ndarray, chunk: int = 1 << 18):
    """Runs of windows with a common anchor: (first window, last window, anchor, document) arrays. starts has the end as well."""
    n = len(text)
    firsts, lasts, anchors = [], [], []
    valid = np.zeros(max(n - SPAN + 1, 0), bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= SPAN:
            valid[a : b - SPAN + 1] = True
    for at in range(0, len(valid), chunk):
        end = min(at + chunk, len(valid))
        rank = (gram_hashes(text[at : end + SPAN - 1]) >> np.uint64(32)).astype(np.uint32)
        place = np.arange(len(rank), dtype=np.int32)
        width, want = 1, REACH + 1
        while width < want:
            step = min(width, want - width)
            left = rank[: len(rank) - step] <= rank[step:]
            place = np.where(left, place[: len(place) - step], place[step:])
            rank = np.minimum(rank[: len(rank) - step], rank[step:])
            width += step
        good = valid[at:end]
        new = good.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~good[:-1]
        stop = good.copy()
        stop[:-1] &= (place[1:] != place[:-1]) | ~good[1:]
        first = np.flatnonzero(new)
        firsts.append(first + at)
        lasts.append(np.flatnonzero(stop) + at)
        anchors.append(place[first].astype(np.int64) + at)
    if not firsts:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    first, last, anchor = (np.concatenate(x) for x in (firsts, lasts, anchors))
    # Windows of one document and anchor on both sides of a chunk's end, or of a document's end, belong to one run or two.
    doc = np.searchsorted(starts, first, side="right") - 1
    if len(first) > 1:
        same = (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1) & (doc[1:] == doc[:-1])
        keep = np.r_[True, ~same]
        last = last[np.r_[~same, True]]
        first, anchor, doc = first[keep], anchor[keep], doc[keep]
    return first, last, anchor, doc


class Block:
    """Texts of some documents and their runs."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.starts = np.r_[0, np.frombuffer(ends, np.int64)]
        self.text = np.frombuffer(unsqueeze(body) + bytes(8), np.uint8)[:-8]
        self.first, self.last, self.anchor, self.doc = anchored(self.text, self.starts)
        named = self.ids[self.doc] != NOBODY  # rows without id take no part
        self.first, self.last, self.anchor, self.doc = (x[named] for x in (self.first, self.last, self.anchor, self.doc))
        self.hash = gram_hashes(self.text, self.anchor) if len(self.anchor) else np.zeros(0, np.uint64)

    def distinct(self, buckets: int):
        """Distinct hashes in order, whether two documents of the block have each, their places up to 255, buckets, and each run's hash."""
        kinds, inverse, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        who = self.ids[self.doc]
        low, high = np.full(len(kinds), NOBODY), np.full(len(kinds), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, who)
        np.maximum.at(high, inverse, who)
        bucket = ((kinds >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
        return kinds, low != high, np.minimum(count, 255).astype(np.uint8), bucket, inverse

    def suffixes(self, runs: np.ndarray, ranges: Ranges):
        """Distinct anchored suffixes of some runs.

        Returns each run's suffix number, and for each suffix its aligned bytes, least document and bucket. The aligned bytes
        are: anchor and what follows (50), what comes before (26), bytes before, windows, two zeros.
        """
        first, last, anchor = self.first[runs], self.last[runs], self.anchor[runs]
        before, after = anchor - first, last + SPAN - anchor
        text, size = self.text, len(self.text)
        column, back = np.arange(SPAN), np.arange(REACH) - REACH

        def made(s: int, e: int) -> np.ndarray:
            rows = np.zeros((e - s, 80), np.uint8)
            rows[:, :SPAN] = np.where(column < after[s:e, None], text[np.minimum(anchor[s:e, None] + column, size - 1)], 0)
            rows[:, SPAN : SPAN + REACH] = np.where(-back <= before[s:e, None], text[np.maximum(anchor[s:e, None] + back, 0)], 0)
            rows[:, 76], rows[:, 77] = before[s:e], (last - first)[s:e] + 1
            return rows

        inverse, aligned, kinds = distinct_rows(made, len(runs), 80)
        who = np.full(len(aligned), NOBODY)
        np.minimum.at(who, inverse, self.ids[self.doc[runs]])
        grams = np.ascontiguousarray(aligned[:, :GRAM]).view(f"S{GRAM}").ravel() if len(aligned) else np.zeros(0, f"S{GRAM}")
        return inverse, aligned, who, ranges.buckets(grams, self.hash[runs[kinds]])

    def windows(self, runs: np.ndarray, ranges: Ranges):
        """Distinct windows of some runs: start and run of each window, its number, and for each number its bytes, least document and bucket (negative)."""
        n = (self.last - self.first)[runs] + 1
        of = np.repeat(np.arange(len(runs)), n)
        start = self.first[runs][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        column = np.arange(SPAN)

        def made(s: int, e: int) -> np.ndarray:
            rows = np.zeros((e - s, 56), np.uint8)
            rows[:, :SPAN] = self.text[start[s:e, None] + column]
            return rows

        inverse, rows, _ = distinct_rows(made, len(start), 56)
        who = np.full(len(rows), NOBODY)
        np.minimum.at(who, inverse, self.ids[self.doc[runs[of]]])
        return start, runs[of], inverse, rows, who, -1 - (row_hashes(rows) >> np.uint64(8)).astype(np.int64) % ranges.total


class Ranges:
    """Buckets of suffixes: ranges of anchors between splitters, each cut into parts by the anchor's hash."""

    def __init__(self, splitters: np.ndarray, wanted: int):
        self.splitters, self.parts = splitters, max(1, -(-wanted // (len(splitters) + 1)))
        self.total = (len(splitters) + 1) * self.parts

    def buckets(self, grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.splitters, grams, side="right") if len(self.splitters) else np.zeros(len(grams), np.int64)
        return at * self.parts + (hashes % np.uint64(self.parts)).astype(np.int64)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    words = rows.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * M1
        h ^= h >> np.uint64(32)
    return h


def distinct_rows(made, n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each row, distinct rows, a row with each number); made(s, e) gives rows s to e. Chunks lose their repeats first."""
    inverse, kept, firsts, total = np.zeros(n, np.int64), [], [], 0
    for s in range(0, n, CHUNK):
        rows = made(s, min(s + CHUNK, n))
        kinds, own = grouped_rows(rows)
        inverse[s : s + len(rows)] = own + total
        total += len(kinds)
        kept.append(rows[kinds])
        firsts.append(kinds + s)
    if not kept:
        return inverse, np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    rows, first = np.concatenate(kept), np.concatenate(firsts)
    if len(kept) > 1:
        kinds, own = grouped_rows(rows)
        inverse, rows, first = own[inverse], rows[kinds], first[kinds]
    return inverse, rows, first


def grouped_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of distinct rows, and each row's distinct row: by a hash of the row, with all equal hashes confirmed."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = rows.view(np.uint64)
    _, kinds, inverse = np.unique(row_hashes(rows), return_index=True, return_inverse=True)
    if not (words == words[kinds[inverse]]).all():
        order, group = multikey_sort(words)
        kinds = order[np.r_[True, group[1:] != group[:-1]]]
        inverse = np.empty(len(rows), np.int64)
        inverse[order] = group
    return kinds, inverse


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the number of each ordered row's group of equal rows.

    Multikey quicksort with 8-byte words as characters: all open parts are partitioned by their next word at once; parts
    of one row, and parts whose rows are all equal, are closed.
    """
    n = len(words)
    order, part = np.arange(n), np.zeros(n, np.int64)
    opened = np.arange(n)  # places of the order that are still open
    for k in range(words.shape[1]):
        if not len(opened):
            break
        rows, parts = order[opened], part[opened]
        by = np.lexsort((words[rows, k], parts))
        rows, parts = rows[by], parts[by]
        order[opened] = rows
        value = words[rows, k]
        new = np.r_[True, (parts[1:] != parts[:-1]) | (value[1:] != value[:-1])]
        head = np.flatnonzero(new)
        part[opened] = opened[head][np.cumsum(new) - 1]
        if k + 1 < words.shape[1]:
            size = np.diff(np.r_[head, len(rows)])
            mine = np.cumsum(new) - 1
            differs = (words[rows, k + 1 :] != words[rows[head[mine]], k + 1 :]).any(1)
            more = (np.bincount(mine, differs) > 0) & (size > 1)
            opened = opened[more[mine]]
    new = np.r_[True, part[1:] != part[:-1]] if n else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def big_endian(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (a multiple of 8) as words that compare like the bytes."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def least_documents(rows: np.ndarray, who: np.ndarray):
    """For aligned suffixes: the least document of equal ones, and (row, window, document) where a window has a smaller one."""
    order, group = multikey_sort(big_endian(rows))
    least = np.full(int(group[-1]) + 1, NOBODY)
    np.minimum.at(least, group, who[order])
    kind = np.empty(len(rows), np.int64)
    kind[order] = group
    heads = order[np.r_[True, group[1:] != group[:-1]]]
    grams = rows[heads, :GRAM]
    new = np.r_[True, (grams[1:] != grams[:-1]).any(1)]
    family = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(family)[family] > 1)
    none = np.zeros(0, np.int64)
    if not len(several):
        return least[kind], none, none, none
    picked = rows[heads[several]]
    # In text order: what comes before, then the anchor and what follows.
    line = np.concatenate([picked[:, SPAN : SPAN + REACH], picked[:, :SPAN]], axis=1)
    windows = picked[:, 77].astype(np.int64)
    of = np.repeat(np.arange(len(several)), windows)
    number = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    shift = picked[of, 76].astype(np.int64) - number
    wide = np.zeros((len(of), 56), np.uint8)
    column = np.arange(SPAN)
    for s in range(0, len(of), 1 << 14):
        e = min(s + (1 << 14), len(of))
        wide[s:e, :SPAN] = line[of[s:e, None], (REACH - shift[s:e])[:, None] + column]
    wide[:, 50] = shift
    order2, group2 = multikey_sort(big_endian(wide))
    own = least[several][of]
    best = np.full(int(group2[-1]) + 1, NOBODY)
    np.minimum.at(best, group2, own[order2])
    found = np.empty(len(of), np.int64)
    found[order2] = best[group2]
    smaller = np.flatnonzero(found < own)
    return least[kind], several[of[smaller]], number[smaller], found[smaller], kind


def least_of_equal(rows: np.ndarray, who: np.ndarray):
    """For windows: the least document of equal ones, in the form of least_documents."""
    order, group = multikey_sort(big_endian(rows))
    least = np.full(int(group[-1]) + 1, NOBODY)
    np.minimum.at(least, group, who[order])
    out, none = np.empty(len(rows), np.int64), np.zeros(0, np.int64)
    out[order] = least[group]
    return out, none, none, none


def write_blocks(docs: DataFrame, rest: bool) -> tuple[DataFrame, int]:
    """Table of blocks in the shared folder, bucketed by block, and its number of text bytes."""
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, ends, body, kept = [], [], bytearray(), []

        def block():
            nonlocal number
            other = b""
            if rest:
                sink = pa.BufferOutputStream()
                table = pa.Table.from_batches(kept)
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                other = squeeze(sink.getvalue().to_pybytes())
            row = pa.RecordBatch.from_arrays([pa.array([(task << 24) + number], pa.int64()), pa.array([len(body)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(ends, np.int64).tobytes()], pa.binary()), pa.array([squeeze(bytes(body))], pa.binary()), pa.array([other], pa.binary())], ["block", "n_bytes", "ids", "ends", "body", "rest"])
            number += 1
            ids.clear(), ends.clear(), body.clear(), kept.clear()
            return row

        for batch in batches:
            begin = 0
            for i, (d, text) in enumerate(zip(batch.column(at_id).to_pylist(), batch.column(at_text).to_pylist())):
                ids.append(NOBODY if d is None else d)
                body += (text or "").encode("utf-8")
                ends.append(len(body))
                if len(body) >= BLOCK_BYTES:
                    if rest:
                        kept.append(batch.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield block()
            if rest and begin < batch.num_rows:
                kept.append(batch.slice(begin))
        if ids:
            yield block()

    spark = docs.sparkSession
    blocks = mapped(docs, run, "block long, n_bytes long, ids binary, ends binary, body binary, rest binary")
    name = f"tracklake_blocks_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    blocks.write.bucketBy(buckets, "block").option("compression", "none").option("path", f"{shared_dir(spark)}/tracklake/{name}").saveAsTable(name)
    table = spark.table(name)
    return table, table.agg(F.sum("n_bytes")).first()[0] or 0


def rows_of(batches):
    """Rows one by one, so that only one block's bytes are copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """Positions of each bucket that occurs, in order of the buckets."""
    if not len(bucket):
        return []
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)


def shared_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, marks): two bits for each of a block's distinct hashes, whether another document has it and whether it is hot."""

    def send(batches):
        for number, *parts in rows_of(batches):
            kinds, several, count, bucket, _ = Block(*parts).distinct(buckets)
            # Six bytes of each hash: the others would rarely change the answer, and only for the better.
            six = kinds.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
            out = [(int(bucket[p[0]]), number, six[p].tobytes(), np.packbits(several[p]).tobytes(), count[p].tobytes()) for p in by_bucket(bucket)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "hashes", "several", "places"])

    sent = mapped(blocks.select("block", "ids", "ends", "body"), send, "bucket long, block long, hashes binary, several binary, places binary")

    def mark(rows: pa.Table) -> pa.Table:
        claim("")
        hashes = rows.column("hashes").to_pylist()
        sizes = [len(h) // 6 for h in hashes]
        value = np.zeros((sum(sizes), 8), np.uint8)
        value[:, 2:] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 6)
        del hashes
        value = value.view(">u8").ravel()
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=n).astype(bool) for s, n in zip(rows.column("several").to_pylist(), sizes)])
        places = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint8)
        order = np.argsort(value, kind="stable")
        head = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1]])
        there = np.diff(np.r_[head, len(order)])
        total = np.add.reduceat(places[order].astype(np.int64), head)
        marks, hot = several.copy(), np.zeros(len(order), bool)
        marks[order[np.repeat(there > 1, there)]] = True
        hot[order[np.repeat(total > HOT, there)]] = True
        cuts = np.cumsum(sizes)[:-1]
        packed = [np.packbits(m).tobytes() + np.packbits(h).tobytes() for m, h in zip(np.split(marks, cuts), np.split(hot, cuts))]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "marks": pa.array(packed, pa.binary())})

    return materialize(sent.groupBy("bucket").applyInArrow(mark, "block long, bucket long, marks binary"), "suffix-marks")


def ranges_of(blocks: DataFrame, wanted: int) -> Ranges:
    """Buckets between anchors that cut those of some blocks, a bounded sample, into even ranges."""

    def sample(batches):
        for ids, ends, body in rows_of(batches):
            block = Block(ids, ends, body)
            least = np.argsort(block.hash * M3)[:SAMPLE_ANCHORS]
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(block.text[p : p + GRAM].tobytes() for p in block.anchor[least].tolist())], pa.binary())], ["sample"])

    few = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block")).limit(SAMPLE_BLOCKS).collect()]
    rows = mapped(blocks.filter(F.col("block").isin(few)).select("ids", "ends", "body"), sample, "sample binary").collect()
    grams = np.sort(np.frombuffer(b"".join(r["sample"] for r in rows), f"S{GRAM}"))
    count = min(wanted, RANGES)
    splitters = np.unique(grams[[len(grams) * i // count for i in range(1, count)]]) if count > 1 and len(grams) else np.zeros(0, f"S{GRAM}")
    return Ranges(splitters, wanted)


def with_lists(blocks: DataFrame, parts: DataFrame, value: str, name: str) -> DataFrame:
    """Blocks with the list of what buckets have sent back; blocks are not moved."""
    lists = parts.groupBy("block").agg(F.collect_list(F.struct("bucket", value)).alias(name))
    return blocks.join(lists.hint("shuffle_hash"), "block", "left")


def marked_runs(block: Block, marks: list | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that other documents may share: those of plain anchors, and those of hot ones."""
    kinds, _, _, bucket, inverse = block.distinct(buckets)
    shared, hot = np.zeros(len(kinds), bool), np.zeros(len(kinds), bool)
    for m in marks or []:
        a, b = np.searchsorted(bucket, [m["bucket"], m["bucket"] + 1])
        bits = np.frombuffer(m["marks"], np.uint8).reshape(2, -1)
        shared[a:b], hot[a:b] = (np.unpackbits(x, count=b - a).astype(bool) for x in bits)
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.flatnonzero((shared & ~hot)[inverse]), np.flatnonzero((shared & hot)[inverse])


def compared(blocks: DataFrame, marks: DataFrame, buckets: int, ranges: Ranges) -> DataFrame:
    """(block, bucket, found): for each block's suffixes or windows of a bucket, documents smaller than the block's own."""

    def send(batches):
        for number, ids, ends, body, mark in rows_of(batches):
            block = Block(ids, ends, body)
            plain, hot = marked_runs(block, mark, buckets)
            out = []
            for rows, who, bucket in (block.suffixes(plain, ranges)[1:], block.windows(hot, ranges)[3:]):
                out += [(int(bucket[p[0]]), number, squeeze(rows[p].tobytes()), squeeze(who[p].tobytes())) for p in by_bucket(bucket)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "rows", "who"])

    def sort_bucket(parts: pa.Table) -> pa.Table:
        claim("")
        parts = parts.sort_by("block")
        whole = parts.column("bucket")[0].as_py() < 0  # windows
        rows = np.frombuffer(b"".join(unsqueeze(r.as_py()) for r in parts.column("rows")), np.uint8).reshape(-1, 56 if whole else 80)
        each = [np.frombuffer(unsqueeze(w.as_py()), np.int64) for w in parts.column("who")]
        who = np.concatenate(each)
        least, head, window, smaller, *kind = least_of_equal(rows, who) if whole else least_documents(rows, who)
        out, at = [], 0
        if len(head):
            # Exceptions by kind of suffix.
            order = np.argsort(head, kind="stable")
            head, window, smaller = head[order], window[order], smaller[order]
            low, high = np.searchsorted(head, kind[0], "left"), np.searchsorted(head, kind[0], "right")
        for number, bucket, own in zip(parts.column("block").to_pylist(), parts.column("bucket").to_pylist(), each):
            end = at + len(own)
            hit = np.flatnonzero(least[at:end] < own)
            found = [hit.astype("<u4").tobytes(), least[at:end][hit].tobytes(), b"", b"", b""]
            if len(head):
                n = (high - low)[at:end]
                of = np.repeat(np.arange(len(own)), n)
                which = np.repeat(low[at:end], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                found[2:] = [of.astype("<u4").tobytes(), window[which].astype(np.uint8).tobytes(), smaller[which].tobytes()]
            if len(hit) or found[2]:
                out.append((number, bucket, squeeze(np.array([len(hit), len(found[2]) // 4], "<i8").tobytes() + b"".join(found))))
            at = end
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "bucket", "found"])

    sent = mapped(with_lists(blocks, marks, "marks", "marks").select("block", "ids", "ends", "body", "marks"), send, "bucket long, block long, rows binary, who binary")
    return materialize(sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, bucket long, found binary"), "suffix-found")


def covered(block: Block, marks: list | None, found: list | None, buckets: int, ranges: Ranges) -> np.ndarray:
    """Which bytes of the block's text go."""
    change = np.zeros(len(block.text) + 1, np.int32)
    plain, hot = marked_runs(block, marks, buckets)
    parts = [(p["bucket"], unsqueeze(p["found"])) for p in found or []]

    def places(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def cover(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)

    if len(plain):
        inverse, rows, who, bucket = block.suffixes(plain, ranges)
        least = who.copy()
        members = np.argsort(inverse, kind="stable")
        begin = np.searchsorted(inverse[members], np.arange(len(rows) + 1))
        doc = block.ids[block.doc[plain]]
        order, ordered = places(bucket)
        for number_of, data in parts:
            if number_of < 0:
                continue
            mine = order[slice(*np.searchsorted(ordered, [number_of, number_of + 1]))]
            hits, more = np.frombuffer(data, "<i8", 2)
            at = 16
            number = np.frombuffer(data, "<u4", hits, at)
            least[mine[number]] = np.frombuffer(data, np.int64, hits, at + 4 * hits)
            at += 12 * hits
            if more:
                number = mine[np.frombuffer(data, "<u4", more, at)]
                window = np.frombuffer(data, np.uint8, more, at + 4 * more).astype(np.int64)
                smaller = np.frombuffer(data, np.int64, more, at + 5 * more)
                n = np.diff(begin)[number]
                of = np.repeat(np.arange(more), n)
                run = members[np.repeat(begin[number], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
                keep = doc[run] > smaller[of]
                start = block.first[plain[run[keep]]] + window[of[keep]]
                cover(start, start + SPAN)
        gone = plain[doc > least[inverse]]
        cover(block.first[gone], block.last[gone] + SPAN)
    if len(hot):
        start, run, inverse, _, who, bucket = block.windows(hot, ranges)
        least = who.copy()
        order, ordered = places(bucket)
        for number_of, data in parts:
            if number_of < 0:
                mine = order[slice(*np.searchsorted(ordered, [number_of, number_of + 1]))]
                hits = int(np.frombuffer(data, "<i8", 1)[0])
                least[mine[np.frombuffer(data, "<u4", hits, 16)]] = np.frombuffer(data, np.int64, hits, 16 + 4 * hits)
        gone = start[block.ids[block.doc[run]] > least[inverse]]
        cover(gone, gone + SPAN)
    return np.cumsum(change[:-1]) > 0


def _prepare(docs: DataFrame, rest: bool):
    ship_code(docs.sparkSession)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    blocks, n_bytes = write_blocks(docs, rest)
    buckets = max(4, -(-n_bytes // HASH_BUCKET_BYTES))
    marks = shared_anchors(blocks, buckets)
    ranges = ranges_of(blocks, max(4, -(-n_bytes // SUFFIX_BUCKET_BYTES)))
    found = compared(blocks, marks, buckets, ranges)
    return with_lists(with_lists(blocks, marks, "marks", "marks"), found, "found", "found"), buckets, ranges


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    joined, buckets, ranges = _prepare(docs.select("doc_id", "text"), False)

    def run(batches):
        for ids, ends, body, marks, found in rows_of(batches):
            block = Block(ids, ends, body)
            gone = covered(block, marks, found, buckets, ranges)
            out = []
            for d, a, b in zip(block.ids.tolist(), block.starts[:-1].tolist(), block.starts[1:].tolist()):
                g = gone[a:b]
                n = int(g.sum())
                spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if n else 0
                kept = block.text[a:b][~g].tobytes() if n else block.text[a:b].tobytes()
                out.append((None if d == NOBODY else d, b - a, n, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 4 + (pa.string(),))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return mapped(joined.select("ids", "ends", "body", "marks", "found"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns, with the repeated bytes taken out of the text; characters cut by that go as well.

    With drop_emptied, rows whose text had bytes and has none left go; those that came in empty stay.
    """
    schema, names = docs.withColumn("doc_id", F.col("doc_id").cast("long")).schema, docs.columns
    joined, buckets, ranges = _prepare(docs, True)

    def run(batches):
        for ids, ends, body, rest, marks, found in rows_of(batches):
            block = Block(ids, ends, body)
            gone = covered(block, marks, found, buckets, ranges)
            table = pa.ipc.open_stream(unsqueeze(rest)).read_all().combine_chunks()
            texts = [block.text[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist())]
            at = names.index("text")
            table = table.set_column(at, "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                table = table.set_column(names.index("n_chars"), "n_chars", pa.array([len(t) for t in texts], table.schema.field("n_chars").type))
            if drop_emptied:
                table = table.filter(pa.array([bool(t) or a == b for t, a, b in zip(texts, block.starts[:-1].tolist(), block.starts[1:].tolist())], pa.bool_()))
            yield from table.to_batches()

    return mapped(joined.select("ids", "ends", "body", "rest", "marks", "found"), run, schema)

