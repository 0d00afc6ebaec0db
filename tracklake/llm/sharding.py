"""Balanced label propagation: linked documents move to a common shard while all shards keep equal counts.

Documents of equal text are linked; a link whose ends lie in different shards is cut. Each document starts in a shard by
a hash. A group of linked documents is one part, or, if it is larger than a shard's quota, parts that fill a shard each
and one that takes the rest. In every round the parts that still have to move are joined to the shards in which their
neighbours, all documents of their group, lie by then; a part asks for the shard that holds most of them among those
with room for it. Large parts, of which there is a bounded number, are placed first, by size. Quotas admit the others by
buckets of a hash, whole buckets as long as they fit, so that no quota is ever exceeded. What is refused asks again in the
next round. A part that no shard has room for is halved. At the end unlinked documents, whose moves cut nothing, even out the
counts: the law is `rows`, no two shards differ by more than one document.

Votes are counts by (group, part, shard): a hot text is pre-aggregated and never gathered. Ranks within a shard come from
counts of hash buckets and ranks within buckets: no task orders a whole shard. Rows equal in id and text are numbered, so
that results do not depend on how the files are laid out.

Edge cases: null texts have the size 16 and the checksum 0 and are linked with each other as equal texts, as empty ones
are; null and repeated ids are separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
#: Rounds before parts without room are halved.
ROUNDS = 8
#: Documents in a bucket for ranking, about.
BUCKET = 8192
#: A part above this share of a shard is large: there are at most SMALL parts of that size for each shard.
SMALL = 64
#: Buckets in which a shard's other requests are admitted.
DOORS = 1024
#: Copies of one row that a task numbers.
COPIES = 4096

GROUP = ["g1", "g2", "size"]


def ranked(rows: DataFrame, group: str, buckets: int, order: list[Column]) -> DataFrame:
    """Adds rank: gapless from 0 within each value of group. Rows need a hash column h."""
    rows = rows.withColumn("_b", F.pmod("h", F.lit(buckets)))
    counts = rows.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    # One row for each shard and bucket: a thousandth of the documents at most.
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1
    out = rows.withColumn("_inside", inside).join(before, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_c")))
    return out.withColumn("rank", (F.col("_before") + F.col("_inside")).cast("long")).drop("_b", "_n", "_before", "_inside", "_g", "_c")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, g1, g2 (hashes of the text) and h (a hash of 63 bits) for every row; equal rows are counted and told apart by number."""
    body = F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("g1"), F.hash(body).alias("g2"))
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), "shards-counted")
    chunks = counted.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    if counted.filter(F.col("_n") > COPIES).limit(1).count():
        chunks = chunks.repartition("doc_id", "g1", "_chunk")
    copies = chunks.withColumn("_copy", F.explode(F.expr(f"sequence(_chunk * {COPIES}, least(_n, (_chunk + 1) * {COPIES}) - 1)")))
    return copies.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "g1", "g2", "_copy"), 1)).drop("_n", "_chunk", "_copy")


def dealt(rows: DataFrame, n: int, quota: int) -> tuple[DataFrame, DataFrame]:
    """Linked rows with linked (members of the group), big (whether the group is large) and part; and the others.

    Large groups are a bounded list: SMALL of them for each shard at most, whatever the corpus. They are broadcast, so that
    only rows of small groups are shuffled for this.
    """
    least = quota // SMALL
    groups = materialize(rows.groupBy(*GROUP).agg(F.count("*").alias("linked")).filter("linked > 1"), "shards-groups")
    large = groups.filter(F.col("linked") > least).withColumn("big", F.lit(True))
    marked = rows.join(F.broadcast(large), GROUP, "left")
    hot = marked.filter("big")
    # Parts of a quota each: places in the group, from 0.
    wide = ranked(hot.filter(F.col("linked") > quota).withColumn("_group", F.xxhash64(*GROUP)), "_group", max(1, -(-n // BUCKET)), [F.col("h"), F.col("doc_id")])
    wide = wide.withColumn("number", F.expr(f"rank div {quota}")).drop("_group", "rank")
    hot = wide.unionByName(hot.filter(F.col("linked") <= quota).withColumn("number", F.lit(0).cast("long")))
    cold = marked.filter("big is null").drop("linked", "big").join(groups.filter(F.col("linked") <= least).hint("shuffle_hash"), GROUP, "left")
    cold = materialize(cold, "shards-cold")
    linked = hot.unionByName(cold.filter("linked is not null").withColumn("big", F.lit(False)).withColumn("number", F.lit(0).cast("long")))
    return linked.withColumn("part", F.xxhash64(*GROUP, "number")).drop("number"), cold.filter("linked is null").withColumn("linked", F.lit(1).cast("long"))


def place_large(held: DataFrame, room: list[int], large: int) -> tuple[DataFrame, DataFrame]:
    """Shards of the large parts, a bounded list, and all other parts' rows. Largest first, each part goes to the shard with room
    where most of its neighbours are by then; takes the sizes off room. A part without such a shard stays among the others."""
    spark = held.sparkSession
    parts = held.groupBy("group", "part").agg(F.sum("c").alias("size")).filter(F.col("size") > large).collect()
    groups = spark.createDataFrame([(g,) for g in {r["group"] for r in parts}], "group long")
    votes: dict[int, dict[int, int]] = {}
    for r in held.join(F.broadcast(groups), "group").groupBy("group", "shard").agg(F.sum("c").alias("votes")).collect():
        votes.setdefault(r["group"], {})[r["shard"]] = r["votes"]
    won = []
    for r in sorted(parts, key=lambda r: (-r["size"], r["part"])):
        mine = votes[r["group"]]
        fits = [s for s in range(len(room)) if room[s] >= r["size"]]
        if fits:
            best = max(fits, key=lambda s: (mine.get(s, 0), room[s], -s))
            room[best] -= r["size"]
            mine[best] = mine.get(best, 0) + r["size"]
            won.append((r["part"], best))
    placed = spark.createDataFrame(won, "part long, shard int")
    return placed, held.join(F.broadcast(placed.select("part")), "part", "left_anti")


def admitted(asked: DataFrame, room: list[int], salt: int) -> DataFrame:
    """Requests (part, wish, size) that the shards' room admits, with shard. Takes the admitted sizes off room."""
    # Doors open in turn as long as all behind them fit.
    asked = asked.filter("wish is not null").withColumn("door", F.pmod(F.xxhash64("part", F.lit(salt)), F.lit(DOORS)))
    opened, closed = [0] * len(room), set()
    for r in asked.groupBy("wish", "door").agg(F.sum("size").alias("s")).orderBy("wish", "door").collect():  # at most DOORS for each shard
        w = r["wish"]
        if w not in closed and r["s"] <= room[w]:
            room[w] -= r["s"]
            opened[w] = r["door"] + 1
        else:
            closed.add(w)
    bounds = F.array(*[F.lit(x) for x in opened])
    return asked.filter(F.col("door") < F.element_at(bounds, F.col("wish") + 1)).select("part", F.col("wish").alias("shard"))


def propagate(held: DataFrame, room: list[int], large: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame | None]:
    """Shards of parts, and the parts that no shard has room for. held: documents c by (group, part, shard) at the start."""
    shards = len(room)
    draw = F.pmod(F.xxhash64("part", "shard"), F.lit(1 << 20))
    settled, waiting = place_large(held, room, large)
    waiting = materialize(waiting, "shards-waiting")
    for k in range(rounds):
        if not waiting.limit(1).count():
            return settled, None
        # Where the neighbours are now: those of settled parts where they went, the others where they began.
        at = held.join(settled.withColumnRenamed("shard", "moved"), "part", "left").select("group", F.coalesce("moved", "shard").alias("shard"), "c")
        votes = at.groupBy("group", "shard").agg(F.sum("c").alias("votes"))
        parts = waiting.groupBy("group", "part").agg(F.sum("c").alias("size"))
        rooms = F.array(*[F.lit(x) for x in room])
        fits = lambda shard: F.element_at(rooms, shard + 1) >= F.col("size")  # noqa: B023, E731
        best = parts.join(votes, "group").groupBy("group", "part", "size").agg(F.max_by(F.when(fits(F.col("shard")), F.col("shard")), F.when(fits(F.col("shard")), F.struct("votes", draw))).alias("wish"))
        # Without such a shard, any one with room: the more of it, the likelier.
        edges, total = [], 0
        for x in room:
            total += x
            edges.append(total)
        lot = F.pmod(F.xxhash64("part", F.lit(k)), F.lit(max(total, 1)))
        other = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x <= lot))  # noqa: B023
        other = F.when(fits(F.least(other, F.lit(shards - 1))), other).otherwise(F.lit(max(range(shards), key=room.__getitem__)))
        asked = materialize(best.withColumn("wish", F.coalesce("wish", F.when(fits(other), other)).cast("int")), f"shards-asked{k}")
        won = materialize(admitted(asked, room, k), f"shards-won{k}")
        settled = settled.unionByName(won)
        waiting = materialize(waiting.join(won, "part", "left_anti"), f"shards-waiting{k}")
    return settled, waiting if waiting.limit(1).count() else None


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and linked (members of the document's group)."""
    rows = numbered(docs)
    rows = materialize(rows.withColumn("start", F.pmod(F.shiftright("h", 20), F.lit(shards)).cast("int")), "shards-rows")
    n = rows.count()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "start", F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(0).cast("long").alias("linked")).withColumnRenamed("start", "shard")
    shares = [n // shards + (s < n % shards) for s in range(shards)]
    quota = max(1, n // shards)
    linked, free = dealt(rows, n, quota)
    linked = materialize(linked, "shards-linked")
    room, placed = list(shares), None
    parted = linked
    while True:
        held = materialize(parted.groupBy(F.xxhash64(*GROUP).alias("group"), "part", F.col("start").alias("shard")).agg(F.count("*").alias("c")), "shards-held")
        settled, waiting = propagate(held, room, quota // SMALL, rounds)
        # Parts of large groups are a bounded list; rows of the others are shuffled by part.
        one = lambda of, big: of.filter(F.col("big") == F.lit(big))
        few = settled.join(one(parted, True).select("part").distinct(), "part", "left_semi")
        moved = one(parted, True).join(F.broadcast(few), "part").unionByName(one(parted, False).join(settled.hint("shuffle_hash"), "part"))
        placed = moved if placed is None else placed.unionByName(moved)
        if waiting is None:
            break
        # Halves by a bit of each row's hash: parts of one document always fit.
        left = waiting.select("part").distinct()
        again = one(parted, True).join(F.broadcast(left.join(one(parted, True).select("part").distinct(), "part", "left_semi")), "part", "left_semi").unionByName(one(parted, False).join(left, "part", "left_semi"))
        parted = materialize(again.withColumn("part", F.xxhash64("part", F.shiftright("h", 40) % 2)).withColumn("h", F.shiftrightunsigned(F.xxhash64("h"), 1)), "shards-halved")
    placed = placed.select("doc_id", "size", "text_crc32", "h", "linked", F.col("shard").alias("at"))
    placed = materialize(placed.unionByName(free.select("doc_id", "size", "text_crc32", "h", "linked", F.col("start").alias("at"))), "shards-placed")
    # Beyond its share a shard gives away unlinked documents, which fill the places that other shards have left.
    buckets = max(1, -(-n // (shards * BUCKET)))
    has = {r["at"]: r["c"] for r in placed.groupBy("at").agg(F.count("*").alias("c")).collect()}
    over = [max(0, has.get(s, 0) - shares[s]) for s in range(shards)]
    order = [F.col("h"), F.col("doc_id")]
    quotas = F.array(*[F.lit(x) for x in over])
    loose = ranked(placed.filter("linked = 1"), "at", buckets, order).withColumn("gives", F.col("rank") < F.element_at(quotas, F.col("at") + 1))
    loose = materialize(loose.drop("rank"), "shards-loose")
    leavers = ranked(loose.filter("gives").withColumn("all", F.lit(0)), "all", max(1, -(-sum(over) // BUCKET)), order)
    bounds, total = [], 0
    for s in range(shards):
        total += max(0, shares[s] - has.get(s, 0))
        bounds.append(total)
    target = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("rank")))
    kept = ["doc_id", "size", "text_crc32", "h", "linked"]
    final = placed.filter("linked > 1").unionByName(loose.filter("not gives").drop("gives")).select(*kept, F.col("at").alias("shard"))
    final = materialize(final.unionByName(leavers.select(*kept, target.cast("int").alias("shard"))), "shards-final")
    out = ranked(final, "shard", buckets, order)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assign(docs, shards)
