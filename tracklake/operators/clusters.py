"""Clustering of matrix rows: k-means, Ward's linkage, silhouettes."""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.shipping import ship_code

#: Rows whose distances a task may hold, 8 bytes for each pair; more are linked from centroids and sizes.
WARD_ROWS = 8192
#: Threads of Ward's one task: nothing else runs beside it.
THREADS = 2
#: Coordinates of the vectors that one task of k-means may hold; tasks that share the starts then.
HELD, PARTS = 1 << 23, 5


def row_vectors(matrix: DataFrame, samples: list[int] | None = None) -> DataFrame:
    """(row_id, ord, x): a row's bins over its samples, missing ones 0."""
    rows = matrix if samples is None else matrix.filter(F.col("sample").isin(*samples))
    parts = rows.groupBy("row_id").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("sample", "bins"))).alias("p"))
    return parts.select("row_id", "ord", F.transform(F.flatten(F.col("p.bins")), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x"))


def _named(assigned: DataFrame) -> DataFrame:
    """Clusters by descending mean, named from 1: (row_id, ord, x, cluster, name)."""
    means = assigned.groupBy("label").agg(F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")).alias("m"), F.min("ord").alias("first"))
    # One row for each cluster.
    ranks = means.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("m"), "first")) - 1).select("label", "cluster")
    return assigned.join(F.broadcast(ranks), "label").drop("label").withColumn("name", F.concat(F.lit("cluster_"), (F.col("cluster") + 1).cast("string")))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (row, start, centre) of rows to the centres (start, centre, coordinate) of several starts."""
    flat = centres.reshape(-1, x.shape[1])
    d = (x * x).sum(1)[:, None] + (flat * flat).sum(1)[None, :] - 2 * (x @ flat.T)
    return np.maximum(d, 0).reshape(len(x), *centres.shape[:2])


def _totals(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums of each centre's rows, with their number and a share of the start's cost (less that of the origin) as two more coordinates."""
    starts, k, dim = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(-1, dim)
    half = (flat * flat).sum(1)[:, None] / 2
    sums, there, cost = np.zeros((k * starts, dim)), np.zeros(k * starts), np.zeros(starts)
    for s in range(0, len(x), 4096):
        rows = x[s : s + 4096]
        score = (half - flat @ rows.T).reshape(k, starts, -1)
        least = score.min(0)
        mine = score == least
        if np.count_nonzero(mine) > least.size:  # equal distances: the first centre's
            mine = score.argmin(0) == np.arange(k)[:, None, None]
        mine = mine.reshape(k * starts, -1).astype(float)
        sums += mine @ rows
        there += mine.sum(1)
        cost += least.sum(1)
    out = np.hstack([sums, there[:, None], np.tile(cost / k, k)[:, None]])
    return out.reshape(k, starts, -1).transpose(1, 0, 2)


def _drawn(x: np.ndarray, hashes: np.ndarray, centres: np.ndarray, seeds: list[int]) -> np.ndarray:
    """For each start the row drawn by its squared distance to the nearest centre (by chance alone without centres), before it its key: the least key of all wins."""
    with np.errstate(over="ignore", divide="ignore"):
        z = hashes[:, None] + np.array(seeds, np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        chance = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53
        weight = _squares(x, centres).min(2) if centres.shape[1] else np.ones(chance.shape)
        keys = np.where(weight > 0, -np.log1p(-chance) / weight, np.inf)
    at = keys.argmin(0)
    return np.hstack([keys[at, np.arange(len(seeds))][:, None], x[at]])


def _best_centres(drawn, totals, dim: int, k: int, starts: list[int], iterations: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Centres and cost of the start of least cost; starts are given by their seeds. All starts move in the same pass over the rows: `drawn` and `totals` are such passes."""
    centres = np.zeros((len(starts), 0, dim))
    for c in range(k):
        centres = np.concatenate([centres, drawn(centres, [r * k + c for r in starts])[:, None, 1:]], axis=1)
    moving = np.arange(len(starts))
    for _ in range(iterations):
        sums = totals(centres[moving])
        there = sums[:, :, dim : dim + 1]
        new = np.where(there > 0, sums[:, :, :dim] / np.maximum(there, 1), centres[moving])
        far = (((new - centres[moving]) ** 2).sum(2) > tolerance**2).any(1)
        centres[moving] = new
        moving = moving[far]
        if not len(moving):
            break
    cost = totals(centres)[:, :, dim + 1].sum(1)
    return centres[cost.argmin()], float(cost.min())


def kmeans(vectors: DataFrame, k: int, restarts: int = 20, iterations: int = 300, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """Best of several starts by cost, each from centres drawn by squared distance; empty clusters do not appear.

    Starts share their passes. Up to HELD coordinates PARTS tasks hold all rows, beyond that a pass is a job over blocks of rows.
    """
    ship_code(vectors.sparkSession)
    starts = [seed + r for r in range(restarts)]

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["n", "h", "x"])

    blocks = vectors.select(F.xxhash64("row_id").alias("h"), "x").mapInArrow(packed, "n long, h binary, x binary").persist()
    unpacked = lambda n, h, x: (np.frombuffer(x).reshape(n, -1), np.frombuffer(h, np.uint64))
    try:
        size = blocks.agg(F.sum("n"), F.sum(F.length("x")), F.min(F.length("x") / F.col("n")), F.max(F.length("x") / F.col("n"))).first()
        if not size[0]:
            return _named(vectors.select("row_id", "ord", "x", F.lit(0).alias("label")))
        if size[2] != size[3]:
            raise ValueError("vectors differ in length")
        dim, parts = int(size[3]) // 8, min(restarts, PARTS)

        def alone(rows: pd.DataFrame) -> pd.DataFrame:
            held = [unpacked(*r) for r in zip(rows["n"], rows["h"], rows["x"])]
            x, h = (np.concatenate(v) for v in zip(*held))
            order = np.argsort(h, kind="stable")  # whatever the blocks were
            x, h = x[order], h[order]
            best = _best_centres(lambda c, seeds: _drawn(x, h, c, seeds), lambda c: _totals(x, c), dim, k, starts[rows["part"].iloc[0] :: parts], iterations, tolerance)
            return pd.DataFrame({"centres": [best[0].tobytes()], "cost": [best[1]]})

        def over_blocks(fn, add):
            """fn of the blocks, added up in each task: a flat array for each."""

            def run(batches):
                out = None
                for b in batches:
                    for r in zip(*(c.to_pylist() for c in b.columns)):
                        one = fn(*unpacked(*r))
                        out = one if out is None else add(out, one)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

            return [np.frombuffer(r["v"]) for r in blocks.mapInArrow(run, "v binary").collect()]

        if size[1] <= 8 * HELD:
            dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("part").applyInPandas(lambda rows: alone(rows), "centres binary, cost double")
            centres = np.frombuffer(min(dealt.collect(), key=lambda r: (r["cost"], r["centres"]))["centres"]).reshape(-1, dim)
        else:

            def drawn(c, seeds):
                got = [g.reshape(len(seeds), -1) for g in over_blocks(lambda x, h: _drawn(x, h, c, seeds), lambda a, b: np.where(b[:, :1] < a[:, :1], b, a))]
                every = np.array(got)
                return every[every[:, :, 0].argmin(0), np.arange(len(seeds))]

            def totals(c):
                return sum(g.reshape(*c.shape[:2], -1) for g in over_blocks(lambda x, h: _totals(x, c), lambda a, b: a + b))

            centres, _ = _best_centres(drawn, totals, dim, k, starts, iterations, tolerance)
    finally:
        blocks.unpersist()

    def labelled(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_squares(x, centres[None])[:, 0].argmin(1), pa.int32())], ["row_id", "ord", "x", "label"])

    kind = dict(vectors.dtypes)
    return _named(vectors.select("row_id", "ord", "x").mapInArrow(labelled, f"row_id {kind['row_id']}, ord {kind['ord']}, x array<double>, label int"))


def ward_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by Ward's criterion, nearest-neighbour chains; clusters are numbered on from the rows."""
    n = len(x)
    if n < 2:
        return []
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            height = d[a, b]
            a, b = min(a, b), max(a, b)
            merges.append((a, b, height))
            others = alive.copy()
            others[[a, b]] = False
            t = size[a] + size[b] + size[others]
            d[a, others] = ((size[a] + size[others]) * d[a, others] + (size[b] + size[others]) * d[b, others] - size[others] * height) / t
            d[others, a] = d[a, others]
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    return _numbered(merges, n)


def _nearest(centre: np.ndarray, size: np.ndarray, alive: np.ndarray, part: np.ndarray, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """The nearest other cluster of each of `part`, and Ward's distance to it.

    Single precision leaves the few clusters that may be nearest within its error; double precision decides between them.
    """
    dim, own = centre.shape[1], np.searchsorted(alive, part)
    square = (centre * centre).sum(1)
    plain = size[alive].max() == size[alive].min()
    # Half a squared distance less the error of its product, and of what is cut from it.
    error = (dim + 16) * 1.2e-7 * max(float(square[alive].max()), 1e-300) * 2
    left = np.hstack([-centre[part], square[part][:, None] / 2 - error, np.ones((len(part), 1))]).astype(np.float32)
    inverse = (1 / size).astype(np.float32)

    def exact(a, b):
        d = np.maximum(square[a] + square[b] - 2 * np.einsum("ij,ij->i", centre[a], centre[b]), 0)
        return d * 2 * size[a] * size[b] / (size[a] + size[b])

    top, found = np.full(len(part), np.inf, np.float32), []
    for s in range(0, len(alive), tile):
        cols = alive[s : s + tile]
        right = np.ascontiguousarray(np.hstack([centre[cols], np.ones((len(cols), 1)), square[cols][:, None] / 2]).astype(np.float32).T)
        low = left @ right
        if not plain:
            low /= inverse[part][:, None] + inverse[cols][None, :]
        here = np.flatnonzero((own >= s) & (own < s + len(cols)))
        low[here, own[here] - s] = np.inf
        at = low.argmin(1)
        weight = 1 / (inverse[part] + inverse[cols[at]]) if not plain else 1
        least = low[np.arange(len(part)), at]
        top = np.minimum(top, least + 2 * error * weight + np.abs(least) * 4e-6).astype(np.float32)
        a, b = np.divmod(np.flatnonzero(low <= top[:, None]), len(cols))
        finite = cols[b] != part[a]
        a, b = a[finite], b[finite]
        if 16 * len(a) > low.size:  # very many equal distances: one of each row
            d = np.maximum(square[part][:, None] + square[cols][None, :] - 2 * centre[part] @ centre[cols].T, 0)
            d *= 2 * size[part][:, None] * size[cols][None, :] / (size[part][:, None] + size[cols][None, :])
            d[here, own[here] - s] = np.inf
            a, b = np.arange(len(part)), d.argmin(1)
            a, b = a[cols[b] != part], b[cols[b] != part]
        found.append((a, cols[b], low[a, b]))
    a, b, low = (np.concatenate(v) for v in zip(*found))
    some = low <= top[a]
    a, b = a[some], b[some]
    d = np.concatenate([exact(part[a[k : k + 16_384]], b[k : k + 16_384]) for k in range(0, len(a), 16_384)])
    order = np.lexsort((b, d, a))
    first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
    return b[first], d[first]


def ward_tree_of_vectors(x: np.ndarray, block: int = 256) -> list[tuple[int, int, float]]:
    """As ward_tree, from centroids and sizes: memory for the rows and `block` rows of distances.

    In each round all pairs that are each other's nearest merge; by Ward's criterion a merged cluster is never nearer to a
    third one than its parts were, so only clusters whose nearest has gone look for it again. Equal distances may merge in
    another order than in ward_tree.
    """
    n = len(x)
    centre, size, alive = x - x.mean(0), np.ones(n), np.arange(n)  # small numbers have small errors
    near, far, done = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
    stale, merges, pool = alive, [], ThreadPool(THREADS)
    while len(alive) > 1:
        parts = [stale[s : s + block] for s in range(0, len(stale), block)]
        look = partial(_nearest, centre, size, alive)
        for part, (b, d) in zip(parts, pool.map(look, parts)):
            near[part], far[part] = b, d
        pairs = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(pairs):
            # Equal distances in a ring: the nearest pair of all merges.
            pairs = alive[[far[alive].argmin()]]
        gone = []
        for a in pairs.tolist():
            a, b = min(a, int(near[a])), max(a, int(near[a]))
            # No cluster is lower than its parts, whatever was rounded.
            done[a] = max(far[a], far[b] if near[b] == a else far[a], done[a], done[b])
            merges.append((a, b, float(done[a])))
            centre[a] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            gone += [a, b]
        alive = np.setdiff1d(alive, [b for _, b, _ in merges[-len(pairs) :]], assume_unique=True)
        stale = alive[np.isin(alive, gone) | np.isin(near[alive], gone)]
    pool.close()
    return _numbered(merges, n)


def _numbered(merges: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
    """In order of height, with numbers of the merged clusters."""
    merges.sort(key=lambda m: m[2])
    number, out = list(range(n)), []
    for k, (a, b, height) in enumerate(merges):
        out.append((number[a], number[b], float(np.sqrt(height))))
        number[a] = n + k
    return out


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    """At most k clusters of n rows, numbered depth first."""
    kids = {n + i: (a, b) for i, (a, b, _) in enumerate(merges)}
    kept = merges[: max(n - k, 0)]
    tops = set(range(n + len(kept))) - {c for a, b, _ in kept for c in (a, b)}
    label, found = [0] * n, 0
    stack = [n + len(merges) - 1] if merges else [0]
    while stack:
        c = stack.pop()
        if c in tops:
            inside = [c]
            while inside:
                m = inside.pop()
                if m < n:
                    label[m] = found
                else:
                    inside.extend(kids[m])
            found += 1
        else:
            stack.extend(reversed(kids[c]))
    return label


def ward(vectors: DataFrame, k: int) -> DataFrame:
    """Ward clustering of all rows in one task: from their distances up to WARD_ROWS rows, from centroids beyond that."""
    held = WARD_ROWS

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        x = np.array(rows["x"].tolist())
        rows["label"] = cut(ward_tree(x) if len(x) <= held else ward_tree_of_vectors(x), len(x), k)
        return rows[["row_id", "ord", "x", "label"]]

    ship_code(vectors.sparkSession)
    kind = dict(vectors.dtypes)
    return _named(vectors.groupBy(F.lit(0).alias("one")).applyInPandas(lambda rows: run(rows.drop(columns="one", errors="ignore")), f"row_id {kind['row_id']}, ord {kind['ord']}, x array<double>, label int"))


def silhouettes(clustered: DataFrame) -> DataFrame:
    """(row_id, cluster, silhouette): mean distance to the own cluster against the nearest other one; 0 for a cluster of one row.

    Rows meet in blocks: each block of rows is compared with each block of all rows, and sums of distances are added up.
    """
    n = clustered.count()
    blocks = max(1, -(-n // 2048))
    dealt = clustered.select("row_id", "cluster", "x").withColumn("b", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    right = dealt.withColumn("o", F.col("b")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    kind = dict(clustered.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"row_id": [], "cluster": [], "other": [], "total": [], "n": []})
        x, y = np.array(a["x"].tolist()), np.array(b["x"].tolist())
        out = []
        for other, at in b.reset_index(drop=True).groupby("cluster").groups.items():
            z = y[at]
            for s in range(0, len(x), 256):
                part = np.sqrt(np.maximum(((x[s : s + 256, None, :] - z[None, :, :]) ** 2).sum(2), 0)).sum(1)
                out.append(pd.DataFrame({"row_id": a["row_id"].to_numpy()[s : s + 256], "cluster": a["cluster"].to_numpy()[s : s + 256], "other": other, "total": part, "n": len(z)}))
        return pd.concat(out)

    ship_code(clustered.sparkSession)
    sums = left.unionByName(right).groupBy("b", "o").applyInPandas(run, f"row_id {kind['row_id']}, cluster int, other int, total double, n long")
    total = sums.groupBy("row_id", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("cluster") == F.col("other")
    scored = total.groupBy("row_id", "cluster").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("size"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("other"),
    )
    top = F.greatest("a", "other")
    return scored.select("row_id", "cluster", F.when((F.col("size") < 2) | F.col("other").isNull() | (top == 0), 0.0).otherwise((F.col("other") - F.col("a")) / top).alias("silhouette"))
