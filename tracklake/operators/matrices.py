"""Matrix algebra on rows (row_id, group_id, ord, sample, bins): one row per region and sample, missing bins NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.missing import aggregate_value, finite, let, narrow, present, reduce_array, total
from tracklake.operators.quantiles import exact_quantiles

FILTER_STATISTICS = ("perBin", "mean", "median", "sum", "min", "max")
NAN_MODES = ("keep", "any_bin", "any_sample", "all_bins")


def stored(matrix: DataFrame) -> DataFrame:
    """bins as single precision with NULL as the only missing value."""
    return matrix.withColumn("bins", F.transform("bins", lambda v: finite(v).cast("float")))


def doubles(bins: Column) -> Column:
    return F.transform(bins, lambda v: v.cast("double"))


def narrowed(bins: Column) -> Column:
    return F.transform(bins, narrow)


# --- filters -----------------------------------------------------------------------------------------------------------


def filter_strand(matrix: DataFrame, strands: list[str]) -> DataFrame:
    return matrix.filter(F.col("strand").isin(*strands))


def filter_values(matrix: DataFrame, low: float = float("-inf"), high: float = float("inf"), statistic: str = "perBin", nan_mode: str = "keep", samples: list[int] | None = None, action: str = "remove", inclusive: bool = False) -> DataFrame:
    """Judge each gated sample of a row by a statistic and by its missing bins.

    A sample fails if its statistic is below low or above high (with inclusive bounds, also if equal). action 'remove'
    drops rows with a failing sample, 'mask' makes that sample's bins missing. all_bins judges all gated samples together.
    """
    if statistic not in FILTER_STATISTICS or nan_mode not in NAN_MODES or action not in ("remove", "mask"):
        raise ValueError("unknown statistic, missing-value mode or action")
    if low > high:
        raise ValueError("the minimum cannot exceed the maximum")
    gated = F.lit(True) if samples is None else F.col("sample").isin(*samples)
    values = doubles(F.col("bins"))
    lowest = reduce_array(values, "min" if statistic == "perBin" else statistic)
    highest = reduce_array(values, "max" if statistic == "perBin" else statistic)
    n = F.size(present(values))
    fails = (lowest <= low) | (highest >= high) if inclusive else (lowest < low) | (highest > high)
    bad = F.coalesce(fails, F.lit(False)) & (n > 0)
    if nan_mode == "any_bin":
        bad |= n < F.size("bins")
    elif nan_mode == "any_sample":
        bad |= n == 0
    judged = matrix.withColumn("_bad", gated & bad).withColumn("_n", F.when(gated, n).otherwise(0)).withColumn("_gated", gated)
    row = Window.partitionBy("row_id")
    if nan_mode == "all_bins":
        empty = (F.sum("_n").over(row) == 0) & (F.max(F.col("_gated").cast("int")).over(row) == 1)
        judged = judged.withColumn("_bad", F.col("_bad") | (F.col("_gated") & empty))
    if action == "remove":
        return judged.withColumn("_any", F.max(F.col("_bad").cast("int")).over(row)).filter("_any = 0").drop("_bad", "_n", "_gated", "_any")
    return judged.withColumn("bins", F.when(F.col("_bad"), F.transform("bins", lambda v: F.lit(None).cast("float"))).otherwise(F.col("bins"))).drop("_bad", "_n", "_gated")


def threshold(matrix: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """At build time: rows with a bin at or below low, or at or above high, go (inclusive bounds, over all samples)."""
    return filter_values(matrix, float("-inf") if low is None else low, float("inf") if high is None else high, inclusive=True)


def skip_zeros(matrix: DataFrame) -> DataFrame:
    """Rows without a present bin other than 0 in any sample go."""
    signal = F.max(F.exists("bins", lambda v: v.isNotNull() & (v != 0)).cast("int")).over(Window.partitionBy("row_id"))
    return matrix.withColumn("_signal", signal).filter("_signal = 1").drop("_signal")


# --- subsets, order and labels -------------------------------------------------------------------------------------------


def subset_samples(matrix: DataFrame, samples: list[int]) -> DataFrame:
    """The given samples in the given order, renumbered from 0; a sample may be named twice."""
    order = matrix.sparkSession.createDataFrame(list(enumerate(samples)), "_new int, sample int")
    return matrix.join(F.broadcast(order), "sample").withColumn("sample", F.col("_new")).drop("_new")


def subset_groups(matrix: DataFrame, groups: list[int]) -> DataFrame:
    order = matrix.sparkSession.createDataFrame([(g, i) for i, g in enumerate(groups)], "group_id int, _new int")
    return matrix.join(F.broadcast(order), "group_id").withColumn("group_id", F.col("_new")).drop("_new")


def relabel(labels: list[str], changes: dict[str, str] | list[str]) -> list[str]:
    """All labels anew (a list), or some of them: keys are labels or places from 1."""
    if isinstance(changes, list):
        if len(changes) != len(labels):
            raise ValueError("the number of labels differs")
        return list(changes)
    out = list(labels)
    for key, new in changes.items():
        at = [i for i, label in enumerate(labels) if label == key] or ([int(key) - 1] if key.isdigit() and 0 < int(key) <= len(labels) else [])
        if not at:
            raise ValueError(f"no label {key!r}")
        for i in at:
            out[i] = new
    return out


def merge_groups(labels: list[str]) -> tuple[list[str], dict[int, int]]:
    """Distinct labels by first occurrence, and each group's new number."""
    first: dict[str, int] = {}
    return list(first), {i: first.setdefault(label, len(first)) for i, label in enumerate(labels)} if labels else {}


def map_groups(matrix: DataFrame, mapping: dict[int, int]) -> DataFrame:
    table = matrix.sparkSession.createDataFrame(list(mapping.items()), "group_id int, _new int")
    return matrix.join(F.broadcast(table), "group_id").withColumn("group_id", F.col("_new")).drop("_new")


def drop_empty_groups(labels: list[str], matrix: DataFrame) -> tuple[list[str], DataFrame]:
    """Labels and rows without the groups that no row has, renumbered."""
    held = {r[0] for r in matrix.select("group_id").distinct().collect()}
    left = [i for i in range(len(labels)) if i in held]
    return [labels[i] for i in left], map_groups(matrix, {g: n for n, g in enumerate(left)})


def row_keys(matrix: DataFrame, using: str, samples: list[int] | None = None) -> DataFrame:
    """(row_id, group_id, ord, key): what rows are sorted by. mean, median, max, min, sum of all bins of the samples, region_length, score."""
    if using in ("region_length", "score"):
        value = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + b["end"] - b["start"]).cast("double") if using == "region_length" else finite(F.col("score"))
        return matrix.select("row_id", "group_id", "ord", value.alias("key")).distinct()
    rows = matrix if samples is None else matrix.filter(F.col("sample").isin(*samples))
    exploded = rows.select("row_id", "group_id", "ord", F.explode("bins").alias("v"))
    return exploded.groupBy("row_id", "group_id", "ord").agg(aggregate_value(F.col("v").cast("double"), using).alias("key"))


#: Rows that one task ranks, about. More are cut into ranges of the key first.
RANK_ROWS = 100_000


def _ranks(keys: DataFrame, within: list[str], key: str, down: bool, missing_first: bool, ties: list[str], per_task: int) -> DataFrame:
    """Adds r, a gapless rank from 0 within `within`, by key and then ties.

    Keys are cut into ranges at approximate percentiles; a range is ranked alone and starts where the ranges before it
    end. Equal keys share a range, so a rank never depends on where the cuts lie.
    """
    rows = keys.count()
    cuts: list[float] = []
    if rows > per_task:
        n = min(1024, rows // per_task)
        cuts = sorted(set(keys.filter(F.col(key).isNotNull()).approxQuantile(key, [(i + 1) / (n + 1) for i in range(n)], 0.001)))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    place = F.when(F.col(key).isNull(), -1 if missing_first else len(cuts) + 1).otherwise(len(cuts) - place if down else place)
    k = F.col(key)
    order = k.desc_nulls_first() if down and missing_first else k.desc_nulls_last() if down else k.asc_nulls_first() if missing_first else k.asc_nulls_last()
    dealt = keys.withColumn("_range", place.cast("int"))
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy(order, *ties)) - 1
    if not cuts:
        return keys.withColumn("r", F.row_number().over(Window.partitionBy(*within).orderBy(order, *ties)) - 1)
    counts = dealt.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    return dealt.withColumn("_inside", inside).join(starts, [*within, "_range"]).withColumn("r", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def sort_order(matrix: DataFrame, using: str = "mean", method: str = "ascend", quantiles: int = 1, samples: list[int] | None = None, per_task: int = RANK_ROWS) -> DataFrame:
    """(row_id, out_group, out_pos): the layout of sorted rows. Ties keep their order both ways.

    Missing keys come last ascending and first descending; a missing score comes last always. With quantiles, all groups
    are pooled and cut at int(q * n / quantiles).
    """
    if method not in ("ascend", "descend", "keep"):
        raise ValueError("unknown method")
    if quantiles < 1 or quantiles > 1 and method == "keep":
        raise ValueError("quantiles need a sorted order")
    keys = matrix.select("row_id", "group_id", "ord", F.col("ord").cast("double").alias("key")).distinct() if method == "keep" else row_keys(matrix, using, samples)
    down = method == "descend"
    first = down and using != "score"
    if quantiles == 1:
        return _ranks(keys, ["group_id"], "key", down, first, ["ord"], per_task).select("row_id", F.col("group_id").alias("out_group"), F.col("r").cast("long").alias("out_pos"))
    n = keys.count()
    if quantiles > n:
        raise ValueError("more quantiles than rows")
    # Group by group in stored order decides ties across groups.
    ranked = _ranks(keys.withColumn("_all", F.lit(0)), ["_all"], "key", down, first, ["group_id", "ord"], per_task)
    bounds = [int(q * n / quantiles) for q in range(quantiles + 1)]
    group = F.lit(quantiles - 1)
    for q in range(quantiles - 2, -1, -1):
        group = F.when(F.col("r") < bounds[q + 1], q).otherwise(group)
    starts = F.array(*[F.lit(b) for b in bounds])
    return ranked.withColumn("out_group", group).select("row_id", "out_group", (F.col("r") - F.element_at(starts, F.col("out_group") + 1)).cast("long").alias("out_pos"))


def restore_order(matrix: DataFrame, regions: DataFrame) -> DataFrame:
    """Layout by the order of a region list (group_id, name, bed_ord): rows that it does not name go, repeated ones all stay."""
    rows = matrix.select("row_id", "group_id", "ord", "name").distinct()
    found = rows.join(regions.select("group_id", "name", "bed_ord"), ["group_id", "name"])
    pos = F.row_number().over(Window.partitionBy("group_id").orderBy("bed_ord", "ord")) - 1
    return found.select("row_id", F.col("group_id").alias("out_group"), pos.cast("long").alias("out_pos"))


def arrange(matrix: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows in their new groups and places; values are joined only here."""
    return matrix.join(layout, "row_id").withColumn("group_id", F.col("out_group")).withColumn("ord", F.col("out_pos")).drop("out_group", "out_pos")


def draw_positions(layout: DataFrame) -> DataFrame:
    """Sorted groups are drawn from the bottom: draw_pos counts down."""
    last = F.max("out_pos").over(Window.partitionBy("out_group"))
    return layout.withColumn("draw_pos", last - F.col("out_pos"))


# --- binding ------------------------------------------------------------------------------------------------------------


def rbind(matrices: list[tuple[DataFrame, list[str]]], blind: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows of several matrices. Groups of equal labels become one, later rows after earlier ones; blind keeps labels apart by matrix."""
    labels: list[str] = []
    out = None
    for k, (matrix, names) in enumerate(matrices):
        mapping = {}
        for g, name in enumerate(names):
            if blind or name not in labels:
                labels.append(name)
                mapping[g] = len(labels) - 1
            else:
                mapping[g] = labels.index(name)
        part = map_groups(matrix, mapping).withColumn("matrix", F.lit(k))
        out = part if out is None else out.unionByName(part)
    place = F.dense_rank().over(Window.partitionBy("group_id").orderBy("matrix", "ord", "row_id")) - 1
    row = F.concat_ws(":", F.col("matrix").cast("string"), F.col("row_id").cast("string"))
    return out.withColumn("ord", place.cast("long")).withColumn("row_id", row).drop("matrix"), labels


def cbind(first: DataFrame, second: DataFrame, identity: list[str] | None = None) -> DataFrame:
    """Samples of second beside those of first, matched by group and complete region; rows of first without a match get missing bins.

    identity: the columns that name a region. None binds by position (row_id), for matrices of equal rows.
    """
    keys = identity or ["row_id"]
    shift = (first.agg(F.max("sample")).first()[0] or 0) + 1
    widths = second.groupBy("sample").agg(F.max(F.size("bins")).alias("width"))
    rows = first.select("row_id", "group_id", "ord", *[c for c in first.columns if c not in ("row_id", "group_id", "ord", "sample", "bins")]).distinct()
    match = second.select(*keys, "sample", "bins")
    held = rows.crossJoin(F.broadcast(widths)).join(match, [*keys, "sample"], "left")
    none = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.lit(None).cast("float"))
    right = held.withColumn("bins", F.coalesce("bins", none)).withColumn("sample", (F.col("sample") + shift).cast("int")).drop("width")
    return first.unionByName(right.select(*first.columns))


def cbind_repeats(second: DataFrame, identity: list[str]) -> DataFrame:
    """Regions that occur more than once, for which a bind by identity is refused."""
    return second.groupBy(*identity, "sample").count().filter("count > 1")


# --- arithmetic ---------------------------------------------------------------------------------------------------------


def add(bins: Column, number: float) -> Column:
    return narrowed(F.transform(bins, lambda v: v.cast("double") + number))


def subtract(bins: Column, number: float) -> Column:
    return add(bins, -number)


def scale(bins: Column, number: float) -> Column:
    return narrowed(F.transform(bins, lambda v: v.cast("double") * number))


def log2(bins: Column) -> Column:
    """Missing where the logarithm is not finite."""
    return narrowed(F.transform(bins, lambda v: F.when(v > 0, F.log2(v.cast("double")))))


def missing_to_zero(bins: Column) -> Column:
    return F.transform(bins, lambda v: F.coalesce(v, F.lit(0).cast("float")))


def scale_rows(bins: Column, by: str, first: int = 0, count: int | None = None) -> Column:
    """Bins over the row's sum, max, min or mean of some bins (all, or `count` from `first`); a zero or missing divisor makes the row missing."""
    if by not in ("sum", "max", "min", "mean"):
        raise ValueError("unknown divisor")
    part = doubles(bins if count is None else F.slice(bins, F.lit(first + 1), F.lit(count)))
    divisor = F.when(F.size(present(part)) > 0, reduce_array(part, by))
    return let(F.struct(divisor.alias("d"), bins.alias("b")), lambda p: narrowed(F.transform(p["b"], lambda v: F.when(p["d"] != 0, v.cast("double") / p["d"]))))


def pseudocount_spec(text: str) -> tuple[str, str | None, float]:
    """A finite number, or an extreme of a side over a number, in any case: 'min-numerator/2' gives ('min', 'numerator', 2)."""
    try:
        kind, side, by = "number", None, float(text)
    except ValueError:
        name, slash, divisor = text.strip().lower().partition("/")
        kind, _, side = name.partition("-")
        if kind not in ("min", "max") or side not in ("numerator", "denominator"):
            raise ValueError(f"no pseudocount: {text!r}") from None
        by = float(divisor) if slash else 1.0
        if by == 0:
            raise ValueError("a pseudocount can't be divided by zero") from None
    if not math.isfinite(by):
        raise ValueError(f"{text!r} isn't finite")
    return kind, side, by


def nonzero_extreme(matrix: DataFrame, which: str) -> DataFrame:
    """(sample, value): smallest or largest present bin other than 0."""
    v = F.col("v").cast("double")
    rows = matrix.select("sample", F.explode("bins").alias("v")).filter((v != 0) & v.isNotNull())
    return rows.groupBy("sample").agg((F.min if which == "min" else F.max)(v).alias("value"))


def compare(num: Column, den: Column, operation: str, pseudocount: float | Column = 0.0, zeros: str = "keep") -> Column:
    """difference, ratio or log2_fold_change of two arrays of bins; zeros: keep, any, both (those pairs become missing)."""
    if operation not in ("difference", "ratio", "log2_fold_change") or zeros not in ("keep", "any", "both"):
        raise ValueError("unknown operation or zero handling")
    pc = F.lit(float(pseudocount)) if isinstance(pseudocount, (int, float)) else pseudocount

    def one(n0: Column, d0: Column) -> Column:
        n, d = n0.cast("double"), d0.cast("double")
        gone = F.lit(False) if zeros == "keep" else ((n == 0) | (d == 0)) if zeros == "any" else ((n == 0) & (d == 0))
        if operation == "difference":
            value = n - d
        else:
            a, b = n + pc, d + pc
            if operation == "ratio":
                value = F.when(b != 0, a / b)
            else:
                relative = (n - d) / b
                # log1p keeps small changes of large operands.
                near = F.log1p(relative) / F.log(F.lit(2.0))
                far = (F.log(F.abs(a)) - F.log(F.abs(b))) / F.log(F.lit(2.0))
                value = F.when((b != 0) & (a != 0) & (F.signum(a) == F.signum(b)), F.when(relative > -1, near).otherwise(far))
        return narrow(F.when(~gone & n.isNotNull() & d.isNotNull(), value))

    return F.zip_with(num, den, one)


def combine(matrices: list[DataFrame], how: str = "mean", identity: list[str] | None = None) -> DataFrame:
    """Sum or mean of the present bins of several matrices with the same samples; missing where none is present.

    The rows are those of the first matrix: what others lack counts as missing, what only they have goes. identity: the
    columns beside group_id that name a region; None aligns by row_id. A region that another matrix has twice is refused.
    """
    if how not in ("sum", "mean"):
        raise ValueError("how must be sum or mean")
    first, *others = matrices
    keys = ["row_id"] if identity is None else ["group_id", *identity]
    out = first
    for k, other in enumerate(others):
        # One row for each key, so that the join can't multiply rows.
        once = other.groupBy(*keys, "sample").agg(F.min("bins").alias(f"_bins{k}"), F.count("*").alias("_n"))
        bins = F.when(F.col("_n") == 1, F.col(f"_bins{k}")).otherwise(F.raise_error(F.lit("a region occurs more than once in a matrix")))
        out = out.join(once.select(*[F.col(c).alias(f"_{c}") for c in (*keys, "sample")], bins.alias(f"_bins{k}")), [first[c].eqNullSafe(F.col(f"_{c}")) for c in (*keys, "sample")], "left").drop(*[f"_{c}" for c in (*keys, "sample")])
    parts = [F.col(f"_bins{k}") for k in range(len(others))]

    def one(v: Column, i: Column) -> Column:
        held = F.filter(F.array(v.cast("double"), *[F.get(p, i).cast("double") for p in parts]), lambda x: x.isNotNull())
        total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
        return narrow(F.when(F.size(held) > 0, total if how == "sum" else total / F.size(held)))

    return out.withColumn("bins", F.transform("bins", one)).drop(*[f"_bins{k}" for k in range(len(others))])


def data_range(matrix: DataFrame) -> DataFrame:
    """min, max, median, p10 and p90 of the present bins of each sample."""
    v = F.col("v").cast("double")
    rows = matrix.select("sample", F.explode("bins").alias("v")).filter(v.isNotNull())
    ends = rows.groupBy("sample").agg(F.min(v).alias("min"), F.max(v).alias("max"))
    inner = exact_quantiles(rows, ["sample"], [0.5, 0.1, 0.9]).select("sample", F.col("q0").alias("median"), F.col("q1").alias("p10"), F.col("q2").alias("p90"))
    return ends.join(inner, "sample")


def row_sums(bins: Column) -> Column:
    return total(present(doubles(bins)))
