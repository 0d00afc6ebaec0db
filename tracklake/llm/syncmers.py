"""Document fingerprints from closed syncmers, in DataFrame functions only.

A string of K bytes is a closed syncmer if the least hash of its inner strings of S bytes lies at its first or last place.
Whether it is one depends on its own bytes alone: equal passages have equal anchors wherever they stand. A fingerprint is
all hashes of a text's distinct syncmers, each with its first place in the text; likeness of two fingerprints is the Dice
coefficient of these sets, and `matched` gives the places of their common anchors in both texts. Because anchors are free
of context, a text is read in pieces of CHUNK bytes, however long it is, and those of an edited text are put together from
what is known: the anchors of the kept half, those of the next document's beginning, and the K - 1 bytes on both sides of
the seam. Only texts are shuffled, once.

The next document by id lies in the same block of documents or is the first of the next block. Blocks are ranges of ids
with about `block` documents each: quantiles of quantiles, of which there are MAX_BLOCKS at most, so that outlying ids cost
nothing. An id that more rows share than a block holds is cut by a hash of the text. The list of blocks and their first
documents is bounded by MAX_BLOCKS and may be broadcast.

Edge cases: null and empty texts have an empty fingerprint, and likeness 1 to each other, 0 to others; texts under K
bytes have the hash of the whole text as their only anchor; null ids come after all others; among rows of equal ids the
order is by a hash of the text; a single row is its own next document; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, S = 23, 8
#: Places that are judged at once.
CHUNK = 4096
#: Anchors that a fingerprint keeps: None is all of them.
KEPT = None
BLOCK, MAX_BLOCKS = 1024, 65_536


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def syncmer_places(data: Column, k: int = K, s: int = S, chunk: int = CHUNK) -> Column:
    """Places (from 1, in bytes) of the closed syncmers of a binary value of k bytes or more.

    Whole arrays of hashes are compared shift by shift: after the shifts 1, 2, 4, ... an element is the least of as many.
    """
    w = k - s  # the inner strings of a place are w + 1

    def doubled(m: Column, width: int) -> Column:
        if width == w + 1:
            return m
        by = min(width, w + 1 - width)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + by))), lambda x: doubled(x, width + by))

    def marked(h: Column) -> Column:
        hit = lambda x, i: (x == F.get(h, i)) | (x == F.get(h, i + w))
        # Behind the last whole place, elements are the least of too few.
        return let(doubled(h, 1), lambda m: F.array_remove(F.transform(m, lambda x, i: F.when(hit(x, i) & (i < F.size(h) - w), i + 1).otherwise(F.lit(0))), 0))

    def piece(c: Column) -> Column:
        part = F.substring(data, c * chunk + 1, F.lit(chunk + k - 1))
        hashes = let(part, lambda d: F.transform(F.sequence(F.lit(1), F.length(d) - (s - 1)), lambda i: F.xxhash64(F.substring(d, i, F.lit(s)))))
        return F.transform(let(hashes, marked), lambda i: (i + c * chunk).cast("int"))

    last = F.floor((F.length(data) - k) / chunk).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), last), piece))


def value(data: Column) -> Column:
    """32-bit hash of an anchor."""
    return F.xxhash64(data).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(data: Column, k: int = K, s: int = S) -> Column:
    """Hashes of the syncmers of a binary value, in order of place; of the value itself if it is short."""
    found = let(syncmer_places(data, k, s), lambda p: hashes_at(data, p, k))
    return F.when(F.length(data) >= k, found).when(F.length(data) > 0, F.array(value(data))).otherwise(F.array().cast("array<bigint>"))


def sketch(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def hashes_at(data: Column, places: Column, k: int = K) -> Column:
    """Hashes of a binary value's anchors at known places."""
    return F.transform(places, lambda i: value(F.substring(data, i, F.lit(k))))


def placed(values: Column, places: Column) -> Column:
    """(values, places) by ascending value, each value once with its first place. Places are under 2 ** 31, values under 2 ** 32."""
    bits = F.lit(1 << 31)

    def firsts(x: Column) -> Column:
        value = lambda y: F.shiftrightunsigned(y, 31)
        return F.filter(x, lambda y, i: (i == 0) | (value(y) != value(F.get(x, i - 1))))

    both = F.zip_with(values, places, lambda v, p: v * bits + p)
    split = lambda x: F.struct(F.transform(x, lambda y: F.shiftrightunsigned(y, 31)).alias("values"), F.transform(x, lambda y: (y % bits).cast("int")).alias("places"))
    return let(F.sort_array(both), lambda x: let(firsts(x), split))


def matched(a: Column, b: Column) -> Column:
    """(place in a, place in b) of the common anchors of two fingerprints (values, places), in order of the first place."""
    common = F.array_intersect(a["values"], b["values"])
    place = lambda f, v: F.element_at(f["places"], F.array_position(f["values"], v).cast("int"))
    return F.sort_array(F.transform(common, lambda v: F.struct(place(a, v).alias("a"), place(b, v).alias("b"))))


def printed(values: Column) -> Column:
    """Eight hexadecimal digits for each value: a ninth, 1, keeps leading zeros until it is taken out with the commas."""
    digits = F.array_join(F.transform(values, lambda x: F.hex(x + F.lit(1 << 32))), ",")
    return F.when(F.size(values) == 0, "").otherwise(F.lower(F.replace(F.concat(F.lit(","), digits), F.lit(",1"), F.lit(""))))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of anchors."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def ordered(docs: DataFrame) -> DataFrame:
    """Adds at and h: rows in ascending order of both are those of descending ids, nulls last, then of a hash of the text."""
    return docs.withColumn("at", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))


def blocks_of(keys: DataFrame, n: int, block: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds block, a number in the order of at and h, to rows. keys: at and h of all n rows."""
    wanted = max(1, min(-(-n // block), MAX_BLOCKS))
    coarse = math.isqrt(wanted - 1) + 1
    fine = -(-wanted // coarse)
    none = F.array().cast("array<bigint>")

    def cut(k: int) -> Column:
        return F.coalesce(F.percentile_approx("at", F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(40 * max(k, 250))), none) if k > 1 else F.first(none)

    def inside(bounds: Column) -> Column:
        """How many bounds a row has passed; one that equals several of them is dealt among these by its hash."""
        below, reached = F.size(F.filter(bounds, lambda x: x < F.col("at"))), F.size(F.filter(bounds, lambda x: x <= F.col("at")))
        return (below + F.floor(F.shiftrightunsigned("h", 43) * (reached - below) / (1 << 20))).cast("int")  # 20 bits of the hash

    # At most 256 numbers here, and MAX_BLOCKS in the broadcast lists.
    first = keys.agg(cut(coarse).alias("bounds")).first()["bounds"] or []
    outer = inside(F.array(*[F.lit(x) for x in first]).cast("array<bigint>"))
    second = materialize(keys.withColumn("outer", outer).groupBy("outer").agg(cut(fine).alias("inner")), "syncmers-bounds")
    return lambda rows: rows.withColumn("outer", outer).join(F.broadcast(second), "outer").withColumn("block", F.col("outer") * fine + inside(F.col("inner"))).drop("outer", "inner")


def _own(docs: DataFrame) -> DataFrame:
    """Each document with the places of its anchors."""

    def found(d: Column) -> Column:
        return F.when(F.length(d) >= K, syncmer_places(d)).when(F.length(d) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))

    return docs.withColumn("places", let(F.encode("text", "UTF-8"), found))


def fingerprints(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, fingerprint_places for every row."""
    docs = ordered(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")))
    keys = materialize(docs.select("at", "h"), "syncmers-keys")
    place = blocks_of(keys, keys.count(), block)
    docs = place(docs).withColumn("ghost", F.lit(0))
    tops = place(keys).groupBy("block").agg(F.min(F.struct("at", "h")).alias("top"))
    order = Window.orderBy("block")  # at most MAX_BLOCKS rows
    above = F.coalesce(F.lag("block").over(order), F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = materialize(tops.select("block", "top.at", "top.h", above.alias("above")), "syncmers-tops")
    # First documents of blocks, one for each, close the block before. Rows that agree in id and hash are one text.
    heads = docs.drop("ghost").join(F.broadcast(tops), ["block", "at", "h"]).groupBy("above").agg(F.max("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("h").alias("h"))
    heads = heads.select("doc_id", "text", "at", "h", F.col("above").alias("block"), F.lit(1).alias("ghost"))
    # Dealt by block before the work begins: the window below needs no other exchange, and only texts are sent.
    rows = _own(docs.select(*heads.columns).unionByName(heads).repartition("block"))
    following = Window.partitionBy("block").orderBy("ghost", "at", F.col("doc_id").isNull(), "h")
    rows = rows.withColumn("next_text", F.lead("text").over(following)).withColumn("next_places", F.lead("places").over(following)).filter("ghost = 0")
    n = F.length("text")
    rows = rows.withColumn("n", n).withColumn("front", F.expr("encode(left(text, length(text) - length(text) div 2), 'UTF-8')")).withColumn("back", F.expr("encode(left(next_text, length(text) div 2), 'UTF-8')"))
    rows = rows.withColumn("values", let(F.encode("text", "UTF-8"), lambda d: hashes_at(d, F.col("places"))))
    rows = rows.withColumn("next_values", let(F.encode("next_text", "UTF-8"), lambda d: hashes_at(d, F.col("next_places"))))

    def within(values: str, places: str, data: str) -> Column:
        """The anchors that end in the kept part: they are the first ones. What is shorter than K bytes has none."""
        return F.slice(values, F.lit(1), F.size(F.filter(places, lambda p: p + (K - 1) <= F.length(data))))

    def edited(whole: Column) -> Column:
        end = F.length("front")
        seam = F.concat(F.substring(F.col("front"), F.greatest(end - (K - 2), F.lit(1)), F.lit(K - 1)), F.substring(F.col("back"), F.lit(1), F.lit(K - 1)))
        crossing = let(seam, lambda d: F.when(F.length(d) >= K, anchors(d)).otherwise(F.array().cast("array<bigint>")))
        parts = F.concat(within("values", "places", "front"), within("next_values", "next_places", "back"), crossing)
        return F.struct(F.sha2(whole, 256).alias("sha"), sketch(F.when(F.length(whole) < K, anchors(whole)).otherwise(parts)).alias("values"))

    rows = rows.withColumn("e", let(F.concat("front", "back"), edited)).withColumn("own", placed(F.col("values"), F.col("places")))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("e.sha").alias("edited_sha256"), printed(F.col("own.values")).alias("fingerprint"), printed(F.col("e.values")).alias("edited_fingerprint"),
        likeness(F.col("own.values"), F.col("e.values")).alias("near_edited"), likeness(F.col("own.values"), F.array_distinct("next_values")).alias("near_next"), F.col("own.places").alias("fingerprint_places"),
    )
