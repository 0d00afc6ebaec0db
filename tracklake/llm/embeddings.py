"""Embedding near-duplicates: exact metric range join of unit vectors.

cos(x, y) >= c means a distance of at most eps = sqrt(2 - 2 c) between the unit vectors. Pivots partition the vectors of
each label into cells of the nearest pivot; a label has as many as the cube root of its classes. Where two vectors of a
pair have different cells, the pair is found in one of the two: a rule on the cells' numbers says which, so each pair of
cells is joined once. A vector is sent to those of the other cells that the triangle inequality does not rule out: if y lies in
cell j and d(x, y) <= eps, then d(x, p_j) <= d(x, p_i) + 2 eps for x's own pivot p_i, and x lies within eps of the plane
between both pivots. So a cell has all neighbours that its own vectors need there and is joined alone. Cells that are
still large are partitioned again by pivots of their own, as long as that lowers the number of pairs to compare. Equal
vectors of a label are one class that counts as often as it occurs. Cells above BLOCK classes are dealt into pairs of
blocks. Large labels whose cells would send more rows than their saved pairs are worth stay whole and are dealt into
blocks too. Within a task, pairs are first compared in LOW dimensions of a fixed rotation, where no distance is larger
than the true one; of what is left the cosine itself decides. A task emits counts and a spanning forest, never all pairs.

One pass sends at most PIVOTS pivots to all tasks; cells that had to wait have their turn in the next one. Where vectors
fill many dimensions evenly, pivots rule out less: `compared` gives the share of a label's pairs that is left.

Edge cases: vectors that are null, of no length, zero, or with null or non-finite components, and rows with a null label
or a null vec_id, are linked with nothing (a null id's component is null and it isn't kept); vectors of different
lengths are never linked; repeated rows count as further vectors; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, ship_code
from .graphs import block_pairs, components

BLOCK = 16_384
#: Pivots of one pass; classes for each pivot, at least; classes above which a cell is partitioned again.
PIVOTS, PER_PIVOT, MANY = 16_384, 16, 8192
#: A further partition stays if it leaves at most this share of a cell's pairs.
GAIN = 0.8
#: Compared pairs that cost as much as a row that is sent to a task; classes above which a label may stay whole for that.
PAIRS_A_ROW, WHOLE = 5000, 4096
#: Dimensions of the first comparison, and pairs of a tile of it.
LOW, TILE = 16, (512, 4096)
KEY = ["label", "dim", "cell"]
PLACED = "class_id long, label string, dim int, unit binary, copies long, cell string, home boolean"


def unit_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, unit (doubles), and a key of the exact vector; the last three are null for vectors without links."""

    def run(batches):
        for batch in batches:
            dims, units, keys = [], [], []
            for v, label, vec_id in zip(*(batch.column(i).to_pylist() for i in (2, 1, 0))):
                good = v is not None and label is not None and vec_id is not None and len(v) > 0 and all(x is not None for x in v)
                x = np.array(v, float) if good else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                if not np.isfinite(top) or top == 0:
                    dims.append(None), units.append(None), keys.append(None)
                    continue
                x = x + 0.0  # no negative zeros
                u = x / top
                dims.append(len(x)), units.append((u / math.sqrt(float(u @ u))).tobytes()), keys.append(hashlib.md5(x.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(keys, pa.binary())], ["vec_id", "label", "dim", "unit", "vec_key"])

    return mapped(rows, run, "vec_id long, label string, dim int, unit binary, vec_key binary")


def pivots_of(n: int) -> int:
    """The cube root of the classes, rounded up, but not more than one for PER_PIVOT classes."""
    k = max(1, round(n ** (1 / 3)))
    return min(k + (k**3 < n), -(-n // PER_PIVOT))


def choose_pivots(placed: DataFrame, sizes: list[tuple], eps: float) -> dict[tuple, np.ndarray]:
    """Pivots by cell, at least 4 eps apart, from a sample of least hash. sizes: (label, dim, cell, classes), a bounded list."""
    wanted = {tuple(k): pivots_of(n) for *k, n in sizes}
    rows = [(*k, min(1.0, 6 * pivots_of(n) / n)) for *k, n in sizes]
    shares = placed.sparkSession.createDataFrame(rows, "label string, dim int, cell string, _share double")
    hashed = F.pmod(F.xxhash64("class_id", "cell"), F.lit(1 << 30))
    few = placed.join(F.broadcast(shares), KEY).filter(hashed < F.col("_share") * (1 << 30)).select(*KEY, "class_id", "unit", hashed.alias("h"))
    out: dict[tuple, list[np.ndarray]] = {}
    for r in sorted(few.collect(), key=lambda r: (r["h"], r["class_id"])):  # six times PIVOTS, about
        key = tuple(r[c] for c in KEY)
        u, known = np.frombuffer(r["unit"]), out.setdefault(key, [])
        if len(known) < wanted[key] and all(np.linalg.norm(u - k) >= 4 * eps for k in known):
            known.append(u)
    return {k: np.array(v) for k, v in out.items() if len(v) > 1}


def joined_in(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of the cells i and j are found in j: for different cells, in exactly one of both, evenly."""
    return (i < j) == ((i + j) % 2 == 0)


def cells(placed: DataFrame, pivots: dict[tuple, np.ndarray], eps: float, bare: bool = False) -> DataFrame:
    """A row for each class and cell that needs it; home marks its own cell. Cells without pivots stay as they are. bare: no vectors."""
    handed = placed.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def run(batches):
        pivots = handed.value
        slack = 1e-9
        for batch in batches:
            at, cell, home = [], [], []
            labels, dims, units, own_cell, own_home = (batch.column(i).to_pylist() for i in (1, 2, 3, 5, 6))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(labels, dims, own_cell)):
                groups.setdefault(k, []).append(i)
            for k, rows in groups.items():
                p = pivots.get(k)
                if p is None:
                    at += rows
                    cell += [k[2]] * len(rows)
                    home += [own_home[i] for i in rows]
                    continue
                is_home = np.array([own_home[i] for i in rows])
                x = np.frombuffer(b"".join(units[i] for i in rows)).reshape(len(rows), -1)
                square = np.maximum(2 - 2 * (x @ p.T), 0)
                own = square.argmin(1)
                every, numbers = np.arange(len(rows)), np.arange(len(p))
                nearest = square[every, own]
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0))[own]
                may = (np.sqrt(square) <= np.sqrt(nearest)[:, None] + 2 * eps + slack) & (square - nearest[:, None] <= 2 * apart * eps + slack)
                # Own rows of the cell meet each other in one of two cells; rows that were sent to it have to meet all.
                may &= joined_in(own[:, None], numbers[None, :]) | ~is_home[:, None]
                may[every, own] = True
                r, c = np.nonzero(may)
                at += [rows[i] for i in r.tolist()]
                cell += [f"{k[2]}.{j}" for j in c.tolist()]
                home += (is_home[r] & (own[r] == c)).tolist()
            got = (batch.set_column(3, "unit", pa.nulls(batch.num_rows, pa.binary())) if bare else batch).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(got.column(i) for i in range(5)), pa.array(cell, pa.string()), pa.array(home, pa.bool_())], ["class_id", "label", "dim", "unit", "copies", "cell", "home"])

    return mapped(placed.select("class_id", "label", "dim", "unit", "copies", "cell", "home"), run, PLACED)


def sized(placed: DataFrame, name: str) -> DataFrame:
    """(label, dim, cell, n, pairs) of each cell: classes, and pairs of a home class with another one that a join compares."""
    homes = F.count_if("home")
    return materialize(placed.groupBy(*KEY).agg(F.count("*").alias("n"), (homes * (homes - 1) / 2 + homes * F.count_if(~F.col("home"))).cast("double").alias("pairs")), name)


def partitioned(classes: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Classes dealt to cells, and the cells' sizes."""
    placed = classes.select("class_id", "label", "dim", "unit", "copies", F.lit("").alias("cell"), F.lit(True).alias("home"))
    whole = sized(placed, "vectors-labels")  # a row for each label
    done, least, step = None, PER_PIVOT + 1, 0
    while True:
        # The largest cells first, as far as one pass's pivots go.
        budget, turn = PIVOTS, []
        for r in whole.filter(F.col("n") >= least).orderBy(F.desc("n"), *KEY).limit(PIVOTS // 2).collect():
            if pivots_of(r["n"]) <= budget:
                budget -= pivots_of(r["n"])
                turn.append((*(r[c] for c in KEY), r["n"]))
        pivots = choose_pivots(placed, turn, eps) if turn else {}
        if not pivots:
            break
        split = cells(placed, pivots, eps)
        sizes = sized(split if step else cells(placed, pivots, eps, bare=True), f"vectors-sizes{step}")
        if not step:
            after = sizes.groupBy("label", "dim").agg(F.sum("n").alias("sent"), F.sum("pairs").alias("after"))
            blocks = F.col("n") * F.ceil(F.col("n") / BLOCK) * PAIRS_A_ROW + F.col("pairs")
            poor = materialize(whole.filter(F.col("n") > WHOLE).join(after, ["label", "dim"]).filter(F.col("sent") * PAIRS_A_ROW + F.col("after") > blocks).select("label", "dim"), "vectors-whole")
            if poor.limit(1).count():
                done = placed.join(F.broadcast(poor), ["label", "dim"], "left_semi").select(placed.columns)  # at most PIVOTS // 2 labels have pivots
                split = cells(placed.join(F.broadcast(poor), ["label", "dim"], "left_anti"), pivots, eps)
                sizes = sizes.join(F.broadcast(poor), ["label", "dim"], "left_anti")
        else:
            # A cell that gains too little keeps its rows and is done with.
            split = materialize(split, f"vectors-split{step}")
            asked = placed.sparkSession.createDataFrame([k[:3] for k in turn], "label string, dim int, cell string")
            parent = F.regexp_replace("cell", r"\.[^.]*$", "")
            after = sizes.withColumn("cell", parent).groupBy(*KEY).agg(F.sum("pairs").alias("after"))
            poor = materialize(asked.join(whole, KEY).join(after, KEY, "left").filter(f"after is null or after > pairs * {GAIN}").select(*KEY), f"vectors-poor{step}")
            stays = placed.join(F.broadcast(poor), KEY, "left_semi")
            done = stays if done is None else done.unionByName(stays)
            under = poor.withColumnRenamed("cell", "_cell")
            # The cell itself, if no pivots were found for it, or its parts.
            split = split.join(F.broadcast(poor), KEY, "left_anti").withColumn("_cell", parent).join(F.broadcast(under), ["label", "dim", "_cell"], "left_anti").drop("_cell")
            split = materialize(split, f"vectors-kept{step}")
            sizes = sized(split, f"vectors-sizes{step}b")
        placed, whole, least, step = split, sizes, MANY, step + 1
        if not whole.filter(F.col("n") >= least).limit(1).count():
            break
        if step == 1:
            placed = materialize(placed, "vectors-cells")
    if done is not None:
        placed = placed.unionByName(done)
        whole = sized(placed, "vectors-sizes")
    return placed, whole


def compared(vectors: DataFrame, least: float = 0.98) -> float:
    """Share of all pairs of different vectors of a label that the join compares."""
    _, classes = classes_of(vectors)
    _, sizes = partitioned(classes, math.sqrt(2 - 2 * least))
    n = classes.groupBy("label", "dim").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
    return (sizes.agg(F.sum("pairs")).first()[0] or 0) / n if n else 0.0


def pieces(home: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """Sides of the pairs between two blocks, or within one, of which at least one is home; the last says that both sides are the same rows."""
    own, sent = left[home[left]], left[~home[left]]
    return [(own, own, True), (own, sent, False)] if left is right else [(own, right, False), (sent, right[home[right]], False)]


def linked_pairs(x: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, bool]], least: float):
    """Linked pairs of positions (a, b), each pair once, in bounded batches."""
    dim = x.shape[1]
    low = x @ np.linalg.qr(np.random.default_rng(0).normal(size=(dim, min(dim, LOW))))[0]
    half = (low * low).sum(1, keepdims=True) / 2
    # A product of these is minus half a squared distance.
    one, two = (np.hstack(m).astype(np.float32) for m in ((low, -half, np.ones_like(half)), (low, np.ones_like(half), -half)))
    enough = np.float32(least - 1 - 1e-5)
    for left, right, same in sides:
        for r in range(0, len(right), TILE[1]):
            cols = right[r : r + TILE[1]]
            turned, exact = np.ascontiguousarray(two[cols].T), None
            for s in range(0, min(len(left), r + len(cols)) if same else len(left), TILE[0]):
                rows = left[s : s + TILE[0]]
                a, b = np.divmod(np.flatnonzero(one[rows] @ turned >= enough), len(cols))
                if 16 * len(a) > len(rows) * len(cols):
                    exact = x[cols].T if exact is None else exact
                    a, b = np.nonzero(x[rows] @ exact >= least)
                elif len(a):
                    cosine = np.concatenate([np.einsum("ij,ij->i", x[rows[a[k : k + 16_384]]], x[cols[b[k : k + 16_384]]]) for k in range(0, len(a), 16_384)])
                    a, b = a[cosine >= least], b[cosine >= least]
                if same:
                    under = a + s < b + r
                    a, b = a[under], b[under]
                if len(a):
                    yield rows[a], cols[b]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least positions of components after links of a with b."""
    while True:
        u, v = root[a], root[b]
        apart = u != v
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def linked_cells(dealt: DataFrame, least: float) -> DataFrame:
    """Rows (class_id, links, other): counts of linked vectors, and edges to another class of the same component."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[3]), int(key[4])
        rows = rows.sort_values("class_id", kind="stable")
        ids, own = rows["class_id"].to_numpy(np.int64), rows["own"].to_numpy()
        x = np.frombuffer(b"".join(rows["unit"])).reshape(len(rows), -1)
        copies, home = rows["copies"].to_numpy(np.int64), rows["home"].to_numpy(bool)
        first = np.flatnonzero(own == i)
        second = first if i == j else np.flatnonzero(own == j)
        counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in linked_pairs(x, pieces(home, first, second), least):
            np.add.at(counts, a, copies[b])
            np.add.at(counts, b, copies[a])
            root = joined(root, a, b)
        some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(ids)))
        out = [pd.DataFrame({"class_id": ids[some], "links": counts[some], "other": ids[some]}), pd.DataFrame({"class_id": ids[moved], "links": 0, "other": ids[root[moved]]})]
        return pd.concat(out).astype("int64")

    return dealt.groupBy("label", "dim", "cell", "i", "j").applyInPandas(run, "class_id long, links long, other long")


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vec_id, label, dim, vec_key of every row, and one class for each distinct vector of a label."""
    ship_code(vectors.sparkSession)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    units = unit_vectors(rows)
    classes = units.filter(F.col("vec_key").isNotNull()).groupBy("label", "dim", "vec_key").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    return materialize(units.select("vec_id", "label", "dim", "vec_key"), "vectors-keys"), materialize(classes, "vectors-classes")


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    units, classes = classes_of(vectors)
    placed, sizes = partitioned(classes, math.sqrt(2 - 2 * least))
    found = materialize(linked_cells(block_pairs(placed.join(sizes.drop("pairs"), KEY), KEY, F.col("class_id"), "n", block), least), "vectors-links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("other").alias("b")), "vectors")
    of_class = classes.join(links, "class_id", "left").join(roots.select(F.col("id").alias("class_id"), "root"), "class_id", "left")
    of_class = of_class.select("label", "dim", "vec_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("_root"))
    out = units.join(of_class, ["label", "dim", "vec_key"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
