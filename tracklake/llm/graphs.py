"""Connected components and bounded pair blocks, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) of every vertex of edges (a, b) that isn't itself the smallest of its component.

    Alternates large and small stars until nothing changes. Minima are pre-aggregated before each shuffle and written, so that
    the joins that hand them back read two tables: adaptive execution splits them where a vertex has very many edges.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, f"{name}-0")
    seen, step = None, 0
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen, step = state, step + 1
        both = pairs.union(pairs.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least{step}")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{name}-large{step}")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lower{step}")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        pairs = materialize(small, f"{name}-{step}")


def block_pairs(rows: DataFrame, key: list[str], member: Column, size: str, limit: int) -> DataFrame:
    """Deal the members of each key into pairs of blocks of about `limit`, so that any two members meet in a task.

    A key of n members makes g = ceil(n / limit) blocks and g (g + 1) / 2 tasks; each member is sent g times. Adds
    columns i, j (the pair of blocks) and own (the member's block).
    """
    g = F.ceil(F.col(size) / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(member), g).cast("int")
    dealt = rows.withColumn("own", own).withColumn("_k", F.explode(F.sequence(F.lit(0), g - 1)))
    return dealt.withColumn("i", F.least("own", "_k")).withColumn("j", F.greatest("own", "_k")).drop("_k")
