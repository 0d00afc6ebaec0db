"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenized once, in a map. Only documents longer than the capacity are cut: the first piece takes the
remainder, all others are full and make a sequence each. The remaining pieces are dealt into cells of about CELL pieces.
Each cell is evolved by ISLANDS islands: a chromosome is a set of bins; crossover injects whole well-filled bins of one
parent into the other, drops the bins that then hold a document twice, and puts their displaced documents back by best
fit; in each generation the best chromosome is tightened, its least filled bins emptied by moves and swaps. After each epoch every island passes its elite to the next island of its cell; the best chromosome of a cell wins.
All tasks see a bounded number of pieces, whatever the corpus or its hot keys.

Edge cases: null or empty texts are one piece that holds the end mark alone; repeated rows and repeated ids are packed
as separate pieces; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import claim, mapped, materialize, ship_code

CAPACITY = 1024
END = 2
CELL = 12_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 8
GENERATIONS = 12
#: Moves and swaps by which the best chromosome of a generation is tightened.
STEPS = 400
#: Bins in which it looks for room.
ROOMY = 16
#: Entries of a worker's word caches.
CACHE_WORDS, ONCE_WORDS = 350_000, 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class Encoder:
    """Ids of the tokenizers library's byte-level vocabulary, for each distinct pre-token once.

    Pre-tokens are merged independently. In such a vocabulary the ids are the ranks of the merges, so that the ranks, read
    from the same file, give the same ids; texts that hold a special token's string go to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.library = path, None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        made = [ranks[bytes(symbols[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"the ids of {path} are not in order of merging")
        self.piece = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.by_property = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # The same for texts in which the standard library's classes agree with those properties: it is faster.
        self.by_class = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.differs = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]").search
        self.cache: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return self.by_property(text) if self.differs(text) else self.by_class(text)

    def whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text. Words seen in two batches stay in the cache; those seen once wait for a second time."""
        cache, once = self.cache, self.once
        parts = [None if any(s in t for s in self.special) else self.split(t) for t in texts]
        absent = {w for words in parts if words for w in words}.difference(cache)
        again = absent.intersection(once)
        for w in again:
            cache[w] = once.pop(w)
        new = absent.difference(again)
        for w in new:
            cache[w] = array("I", self.piece(w)).tobytes()
        out = [self.whole(t) if words is None else b"".join(map(cache.__getitem__, words)) for t, words in zip(texts, parts)]
        if len(once) > ONCE_WORDS:
            once.clear()
        for w in new:
            once[w] = cache.pop(w)
        if len(cache) > CACHE_WORDS:  # the words that came first stay: they are the frequent ones
            for w in again:
                del cache[w]
        return out


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    claim("packing", _LOADED.clear)
    return _LOADED[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids; the first may be shorter."""
    n = len(ids) // 4
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece of each document's ids, the end mark included."""
    end = END.to_bytes(4, "little")

    def run(batches):
        encoder = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                rows = []
                for d, ids in zip(part.column(0).to_pylist(), encoder.batch([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    rows += [(d, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(ids, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), run, PIECES, "packing")


class Bins:
    """Open bins by free space; the tightest bin that fits is found by one bit operation."""

    def __init__(self, capacity: int):
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, number: int, free: int) -> None:
        self.free[free].append(number)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int]:
        """(bin, free space) of the tightest fit, or (-1, 0)."""
        fits = self.mask >> size
        if not fits:
            return -1, 0
        free = size + (fits & -fits).bit_length() - 1
        number = self.free[free].pop()
        if not self.free[free]:
            self.mask &= ~(1 << free)
        return number, free


def best_fit(bin_of: np.ndarray, fill: list[int], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items into bins in the given order; bin_of and fill change in place. Bins of fill 0 are not reopened."""
    bins = Bins(capacity)
    for b, f in enumerate(fill):
        if 0 < f < capacity:
            bins.put(b, capacity - f)
    for i in items:
        size = sizes[i]
        b, free = bins.take(size)
        if b < 0:
            b, free = len(fill), capacity
            fill.append(0)
        bin_of[i] = b
        fill[b] += size
        if free > size:
            bins.put(b, free - size)


def fitness(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller full bins."""
    fill = np.bincount(bin_of, weights=sizes)
    fill = fill[fill > 0]
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def descending(sizes: np.ndarray, noise: float, rng: np.random.Generator, among: np.ndarray | None = None) -> list[int]:
    among = np.arange(len(sizes)) if among is None else among
    return among[np.argsort(-(sizes[among] * (1 + noise * rng.random(len(among)))), kind="stable")].tolist()


def cross(mother: np.ndarray, father: np.ndarray, sizes: np.ndarray, as_list: list[int], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject some of the father's well-filled bins into the mother; repair by best fit."""
    fill = np.bincount(father, weights=sizes)
    good = np.flatnonzero(fill >= 0.995 * capacity)
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < 0.3]] = True
    injected = chosen[father]
    hit = np.zeros(int(mother.max()) + 1, bool)
    hit[mother[injected]] = True
    # The least filled of the other bins are opened as well, as mutation.
    own = np.bincount(mother, weights=sizes)
    loose = np.flatnonzero((own > 0) & (own < 0.98 * capacity) & ~hit)
    hit[loose[rng.random(len(loose)) < 0.5]] = True
    displaced = hit[mother] & ~injected
    child = np.full(len(sizes), -1, np.int64)
    kept = ~hit[mother]
    _, child[kept] = np.unique(mother[kept], return_inverse=True)
    n = int(child.max()) + 1 if kept.any() else 0
    if injected.any():
        child[injected] = n + np.unique(father[injected], return_inverse=True)[1]
        n = int(child.max()) + 1
    filled = np.bincount(child[child >= 0], weights=sizes[child >= 0], minlength=n).astype(int).tolist()
    best_fit(child, filled, descending(sizes, 0.02, rng, np.flatnonzero(displaced)), as_list, capacity)
    return child


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of bins (Martello and Toth's second one).

    For each least size considered: what is so large that nothing considered fits beside it has a bin of its own, items
    above half have one each, and the others need bins beyond the room that those leave.
    """
    ordered = np.sort(sizes.astype(np.int64))
    total = np.r_[0, np.cumsum(ordered)]
    half = np.searchsorted(ordered, capacity // 2, "right")
    least = np.unique(np.r_[1, ordered[:half]])
    first = np.searchsorted(ordered, least, "left")
    alone = np.maximum(np.searchsorted(ordered, capacity - least, "right"), half)
    room = capacity * (alone - half) - (total[alone] - total[half])
    over = np.maximum(total[half] - total[np.minimum(first, half)] - room, 0)
    return int((len(ordered) - half - (-over // capacity)).max(initial=0))


def tighten(bin_of: np.ndarray, sizes: np.ndarray, capacity: int, steps: int = STEPS) -> np.ndarray:
    """Empty the least filled bin by moves and swaps that fill other bins better, then the next one, for so many steps.

    An item moves to the tightest bin that takes it. If none does, the smallest item waits until a swap between two other
    bins has made room for it; and if there is no such swap, an item changes places with the smaller one whose bin gains
    most. Each step takes something out of the least filled bin, so steps never undo each other.
    """
    bin_of, sizes = bin_of.copy(), sizes.astype(np.int64)
    fill = np.bincount(bin_of, weights=sizes).astype(np.int64)

    def put(item: int, target: int) -> None:
        fill[bin_of[item]] -= sizes[item]
        fill[target] += sizes[item]
        bin_of[item] = target

    def exchange(giving: np.ndarray, least: int, most: np.ndarray) -> tuple[int, int]:
        """(item of giving, other item) of the largest difference in size from least to the most that the other's bin takes."""
        gain = sizes[giving][:, None] - sizes[None, :]
        gain[(gain < least) | (gain > most[bin_of][None, :])] = 0
        k, other = divmod(int(gain.argmax()), len(sizes))
        return (int(giving[k]), other) if gain[k, other] > 0 else (-1, -1)

    for _ in range(steps):
        loosest = int(np.where(fill > 0, fill, capacity + 1).argmin())
        free = np.where(fill > 0, capacity - fill, 0)
        free[loosest] = -1
        mine = np.flatnonzero(bin_of == loosest)
        mine = mine[np.argsort(-sizes[mine], kind="stable")]
        placed = next((i for i in mine.tolist() if sizes[i] <= free.max()), -1)
        if placed < 0:
            small = int(mine[-1])
            for roomy in np.argsort(-free, kind="stable")[:ROOMY].tolist():
                others = free.copy()
                others[roomy] = -1
                a, b = exchange(np.flatnonzero(bin_of == roomy), int(sizes[small]) - int(free[roomy]), others)
                if a >= 0:
                    target = int(bin_of[b])
                    put(b, roomy), put(a, target), put(small, roomy)
                    break
            else:
                a, b = exchange(mine, 1, free)
                if a < 0:
                    break
                target = int(bin_of[b])
                put(b, loosest), put(a, target)
            continue
        put(placed, int(np.where(free >= sizes[placed], free, capacity + 1).argmin()))
    return bin_of


def evolve(sizes: np.ndarray, seed: int, elites: list[np.ndarray], capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """Best chromosome (a bin for each item) of one island. It ends early where no chromosome can have fewer bins."""
    rng = np.random.default_rng(seed)
    as_list = sizes.astype(int).tolist()
    people = list(elites)
    while len(people) < population:
        child = np.full(len(sizes), -1, np.int64)
        best_fit(child, [], descending(sizes, 0.0 if not people else 0.03 * len(people), rng), as_list, capacity)
        people.append(child)
    rank = lambda p: fitness(p, sizes, capacity)
    people.sort(key=rank, reverse=True)
    least = fewest(sizes, capacity)
    for _ in range(generations):
        if -rank(people[0])[0] <= least:
            break
        young = [tighten(people[0], sizes, capacity)]
        if -rank(young[0])[0] > least:
            young += [cross(people[int(rng.integers(0, len(people)))], people[int(rng.integers(0, len(people)))], sizes, as_list, capacity, rng) for _ in range(population)]
        people = sorted(people + young, key=rank, reverse=True)[:population]
    return people[0]


def _ordered(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values("row", kind="stable").reset_index(drop=True)


def pack(parts: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """sequence_id and offset for each piece. parts is read several times: give a table, as pack_documents does."""
    ship_code(parts.sparkSession)
    full = parts.filter(F.col("length") >= capacity)
    rest = parts.filter(F.col("length") < capacity).withColumn("row", F.monotonically_increasing_id())
    cells = max(1, -(-parts.filter(F.col("length") < capacity).count() // cell))
    rest = materialize(rest.withColumn("cell", F.pmod(F.xxhash64("doc_id", "row"), F.lit(cells)).cast("int")), "packing-rest")
    sizes = rest.select("cell", "row", "length").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    elites = None
    for epoch in range(epochs):

        def island(key, items, elite=None, epoch=epoch):
            claim("")
            items = _ordered(items)
            if not len(items):
                return pd.DataFrame({"cell": [], "island": [], "bins": [], "n_bins": [], "quality": []})
            lengths = items["length"].to_numpy(np.int64)
            known = [] if elite is None else [np.frombuffer(b, "<i4").astype(np.int64) for b in elite["bins"]]
            best = evolve(lengths, 1_000_003 * int(key[0]) + 1009 * int(key[1]) + epoch, known, capacity)
            n, quality = fitness(best, lengths, capacity)
            return pd.DataFrame({"cell": [key[0]], "island": [key[1]], "bins": [best.astype("<i4").tobytes()], "n_bins": [-n], "quality": [quality]})

        schema = "cell int, island int, bins binary, n_bins long, quality double"
        if elites is None:
            found = sizes.groupBy("cell", "island").applyInPandas(lambda key, items: island(key, items), schema)
        else:
            moved = elites.withColumn("island", F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))))
            found = sizes.groupBy("cell", "island").cogroup(moved.groupBy("cell", "island")).applyInPandas(lambda key, items, elite: island(key, items, elite), schema)
        elites = materialize(found, f"packing-epoch{epoch}")

    def settle(key, items, elite):
        items = _ordered(items)
        if not len(items):
            return pd.DataFrame({c.split()[0]: [] for c in PACKED.split(", ")})
        best = elite.sort_values(["n_bins", "quality", "island"], ascending=[True, False, True]).iloc[0]
        items["sequence_id"] = np.unique(np.frombuffer(best["bins"], "<i4"), return_inverse=True)[1]
        items = items.sort_values(["sequence_id", "row"], kind="stable")
        items["offset"] = items.groupby("sequence_id")["length"].cumsum() - items["length"]
        items["sequence_id"] = items["sequence_id"] * cells + int(key[0])
        return items[[c.split()[0] for c in PACKED.split(", ")]]

    best = rest.groupBy("cell").cogroup(elites.groupBy("cell")).applyInPandas(settle, PACKED)
    # Full pieces take negative numbers: unique by partition and row, and apart from all others.
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return best.unionByName(alone)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, vocabulary, capacity), "packing-pieces"), capacity)

