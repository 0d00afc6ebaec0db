"""Near-duplicates by b-bit MinHash.

1. Each document's shingle set gives HASHES minima; their low BITS bits are packed into a signature, and BANDS bands of
   whole minima give bucket keys. Equal sets form a class, of which one representative goes on.
2. Buckets of two or more classes compare packed signatures by bit counts, corrected for chance collisions. What is
   clearly below the threshold goes; of the rest only a spanning forest leaves a task, never all pairs.
3. The forests' components are candidate groups. Their members' full sets, read again from the texts, meet once in a
   group (or pair of blocks of a large one) and are compared exactly, most alike first; pairs that are connected
   already are skipped. The verified links' components are the result.

With similarity s a pair shares a bucket with probability 1 - (1 - s**4)**32: all but 5 in a million at s = 0.75, fewer
above. Buckets above BLOCK members and groups above GROUP are dealt into pairs of blocks.

Edge cases: null and empty texts have no shingles and are linked with nothing; rows of a null doc_id are linked with
nothing, have no component and aren't kept; rows that share a doc_id are one document; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import claim, mapped, materialize, ship_code
from .graphs import block_pairs, components

HASHES, BANDS, BITS = 128, 32, 4
BLOCK = 2048
#: Members of a group that is confirmed by one task; larger groups are dealt into pairs of blocks.
GROUP = 512
#: Shingles of a set that counts as one member when a group is dealt into blocks.
LONG = 4096
#: Below the threshold by five standard deviations of the estimate, a pair isn't compared exactly.
MARGIN = 0.2
#: Up to so many ids are broadcast (about 50 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 500_000

NIBBLES = np.uint64(0x1111111111111111)


def pack_bits(minima: np.ndarray) -> bytes:
    """The low 4 bits of each minimum, two to a byte."""
    low = (minima & np.uint64(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def similarities(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimates for all pairs of rows of packed signatures, as uint64 words; corrected for chance collisions."""
    differ = np.zeros((len(left), len(right)), np.uint16)
    for k in range(left.shape[1]):
        x = left[:, None, k] ^ right[None, :, k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & NIBBLES)
    chance = 1 / (1 << BITS)
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    def run(batches):
        a, b = shingles.permutations(HASHES)
        shingles.hold_words()
        for batch in batches:
            counts, keys, bands, packed = [], [], [], []
            for text in batch.column(1).to_pylist():
                values = shingles.shingle_set(text, size)
                counts.append(len(values))
                if not len(values):
                    keys.append(None)
                    bands.append(None)
                    packed.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                low = shingles.minima(values, a, b)
                rows = low.reshape(BANDS, -1)
                h = np.arange(BANDS, dtype=np.uint64)
                for c in rows.T:
                    h = shingles.mix(h + c)
                bands.append(h.view(np.int64))
                packed.append(pack_bits(low))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "set_key", "bands", "signature"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary", "shingles")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def alike(words: np.ndarray, own: np.ndarray, i: int, j: int, cutoff: float, chunk: int = 256):
    """(x, y, estimate) arrays of the pairs that this task compares, in chunks: across its two blocks, or within its only one."""
    left = np.arange(len(own)) if i == j else np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    for at in range(0, len(left), chunk):
        rows = left[at : at + chunk]
        found = similarities(words[rows], words[right])
        x, y = np.nonzero(found >= cutoff)
        keep = rows[x] < right[y] if i == j else slice(None)
        x, y = x[keep], y[keep]
        yield rows[x], right[y], found[x, y]


def as_words(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1)


def estimated_links(buckets: DataFrame, cutoff: float) -> DataFrame:
    """Spanning forests (a, b) of the estimated links within each bucket. Rows of buckets stream in order through a task."""

    def of_group(ids, packed, own, i, j):
        if len(ids) < 2:
            return
        forest = Forest(len(ids))
        for xs, ys, _ in alike(as_words(packed), np.array(own), i, j, cutoff):
            for x, y in zip(xs.tolist(), ys.tolist()):
                if forest.join(x, y):
                    yield ids[x], ids[y]

    def run(batches):
        key, group, out, last = None, ([], [], []), [], None
        for batch in batches:
            for bucket, i, j, own, cid, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, i, j) != key:
                    if key is not None:
                        out += of_group(*group, *key[1:])
                    key, group = (bucket, i, j), ([], [], [])
                for c, v in zip(group, (cid, packed, own)):
                    c.append(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if key is not None:
            out += of_group(*group, *key[1:])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return mapped(buckets.select("bucket", "i", "j", "own", "class_id", "signature").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), run, "a long, b long")


def verified_links(members: DataFrame, threshold: float, cutoff: float) -> DataFrame:
    """Spanning forests of the exact links within each group or pair of blocks."""
    percent = round(100 * threshold)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        claim("")
        i, j = int(key[1]), int(key[2])
        ids = rows["class_id"].tolist()
        sets = [np.frombuffer(s, np.uint64) for s in rows["values"]]
        forest, out = Forest(len(ids)), []
        # A chunk's pairs at a time, most alike first; pairs that are connected already aren't looked at.
        for xs, ys, found in alike(as_words(rows["signature"].tolist()), rows["own"].to_numpy(), i, j, cutoff):
            roots = np.array([forest.root(x) for x in range(len(ids))])
            apart = np.flatnonzero(roots[xs] != roots[ys])
            for k in apart[np.argsort(-found[apart], kind="stable")].tolist():
                x, y = int(xs[k]), int(ys[k])
                if forest.root(x) == forest.root(y):
                    continue
                a, b = sets[x], sets[y]
                if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    forest.join(x, y)
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("grp", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, size: int = 5, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    ship_code(spark)
    cutoff = threshold - MARGIN
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    signed = materialize(signatures(docs, size), "neardup-signed")
    linked = signed.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(linked.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "neardup-classes")
    reps = linked.select(F.col("doc_id").alias("class_id"), "set_key", "bands", "signature", "n_shingles").join(classes, ["class_id", "set_key"])
    reps = materialize(reps.select("class_id", "bands", "signature", "n_shingles"), "neardup-reps")
    banded = reps.select("class_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    banded = materialize(banded.join(shared, "bucket"), "neardup-buckets")
    buckets = banded.join(reps.select("class_id", "signature"), "class_id")
    likely = components(estimated_links(block_pairs(buckets, ["bucket"], F.col("class_id"), "n", block), cutoff), "neardup-likely")
    groups = likely.unionByName(likely.select(F.col("root").alias("id"), "root").distinct()).select(F.col("id").alias("class_id"), F.col("root").alias("grp"))
    groups = materialize(groups, "neardup-groups")
    ids = groups.select(F.col("class_id").alias("doc_id"))
    wanted = F.broadcast(ids) if groups.count() <= BROADCAST_IDS else ids

    def sets(batches):
        shingles.hold_words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles.shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["class_id", "values"])

    values = mapped(docs.join(wanted, "doc_id", "left_semi"), sets, "class_id long, values binary", "shingles")
    # Long sets make a group larger, so that a block's sets are at most about GROUP * LONG shingles.
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") / LONG)).cast("long")
    sizes = groups.join(reps.select("class_id", "n_shingles"), "class_id").groupBy("grp").agg(weight.alias("n"))
    members = groups.join(materialize(sizes, "neardup-sizes"), "grp").join(reps.select("class_id", "signature"), "class_id").join(values, "class_id")
    exact = components(verified_links(block_pairs(members, ["grp"], F.col("class_id"), "n", min(block, GROUP)), threshold, cutoff), "neardup-exact")
    of_class = classes.join(exact.select(F.col("id").alias("class_id"), "root"), "class_id", "left").select("set_key", F.coalesce("root", "class_id").alias("_component"))
    out = signed.join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows, all columns, of one document of each group. Of rows that share a doc_id that of least text hash stays; of null ids all."""
    found = near_duplicates(docs, threshold)
    kept = found.groupBy("doc_id").agg(F.first("kept").alias("_one"), F.count("*").alias("_rows")).filter(F.col("_one") | F.col("doc_id").isNull())
    kept = materialize(kept.select(F.col("doc_id").alias("_kept"), "_rows"), "neardup-kept")
    # The counted ids are broadcast up to that bound, so that texts stay where they are; beyond it they are shuffled.
    ids = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    out = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")
    if kept.filter("_rows > 1 and _kept is not null").limit(1).count():
        # One row for each id, chosen before the shuffle as well: an id of very many rows is never gathered.
        whole, text = F.struct(*[out[c] for c in docs.columns]), out["text"]
        named = out.filter(out["doc_id"].isNotNull()).groupBy("doc_id").agg(F.min_by(whole, F.struct(F.xxhash64(text), F.xxhash64(whole))).alias("row")).select("row.*")
        out = named.unionByName(out.filter(F.col("doc_id").isNull()))
    return out
