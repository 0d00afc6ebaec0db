"""Text formats: parsing rules, and files written and read again."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import clusters, matrices as X, profiles as P
from tracklake.sources import text as S


def write(tmp_path, name, text, compress=False):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()) if compress else text.encode())
    return str(path)


def test_bed(spark, tmp_path):
    text = "track name=x\nch1\t-5\t50\ta\t1.5\t+\nch1\t60\t90\ta\t.\t*\nch1\t9\t9\tempty\t0\t+\n#First\nch2\t10\t20\tb\t2\t-\n#Second\nch3\t1\t5\t.\t3\t.\n"
    rows = {r.name: r for r in S.read_bed(spark, write(tmp_path, "a.bed.gz", text, True)).collect()}
    assert set(rows) == {"a", "a_r1", "b", "ch3:1-5"}
    assert [tuple(b) for b in rows["a"].blocks] == [(0, 50)] and rows["a"].score == 1.5 and rows["a_r1"].score is None and rows["a_r1"].strand == "."
    assert (rows["a"].group, rows["b"].group, rows["ch3:1-5"].group) == ("First", "Second", "genes") and (rows["a"].group_id, rows["b"].group_id, rows["ch3:1-5"].group_id) == (0, 1, 2)


def test_bed12_and_bed3(spark, tmp_path):
    twelve = "c\t100\t200\tx\t0\t+\t100\t200\t0\t2\t10,20,\t0,80,\nc\t100\t200\ty\t0\t+\t100\t200\t0\t2\t10,\t0,\n"
    rows = {r.name: [tuple(b) for b in r.blocks] for r in S.read_bed(spark, write(tmp_path, "b.bed", twelve)).collect()}
    assert rows == {"x": [(100, 110), (180, 200)], "y": [(100, 200)]}
    assert [r.name for r in S.read_bed(spark, write(tmp_path, "c.bed", "c 1 5\n")).collect()] == ["c:1-5"]


def test_gtf_and_masks(spark, tmp_path):
    gtf = 'c\ts\ttranscript\t1\t100\t.\t+\t0\tgene_id g; transcript_id "t1";\nc\ts\texon\t1\t10\t.\t+\t0\ttranscript_id "t1"; gene_id g\nc\ts\texon\t51\t60\t.\t+\t0\ttranscript_id "t1";\nc\ts\ttranscript\t5\t9\t.\t-\t0\ttranscript_id "t1";\n'
    path = write(tmp_path, "a.gtf", gtf)
    assert S.is_gtf(spark, path) and [tuple(b) for b in S.read_gtf(spark, path).first().blocks] == [(0, 100)]
    assert [tuple(b) for b in S.read_gtf(spark, path, keep_exons=True).first().blocks] == [(0, 10), (50, 60)]
    mask = S.read_mask(spark, write(tmp_path, "m.bed", "c 5 10 n 0 +\nc 10 20 n 0 +\nc 15 30 n 0 -\nd 1 2\n"))
    assert {tuple(r) for r in mask.select("chrom", "strand", "start", "end").collect()} == {("c", "+", 5, 20), ("c", "-", 15, 30), ("d", ".", 1, 2)}
    assert {(r.strand, r.start, r.end) for r in S.probes(mask).collect()} == {("+", 5, 15), ("-", 20, 30)}


def test_sam(spark, tmp_path):
    sam = "@HD\tVN:1.0\n@SQ\tSN:c\tLN:1000\nr1\t99\tc\t101\t60\t10M5N10M\t=\t151\t100\t*\t*\tNM:i:0\tRG:Z:g1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    rows, sizes = S.read_sam(spark, write(tmp_path, "a.sam", sam))
    a, b = sorted(rows.collect(), key=lambda r: r.qname)
    assert (a.pos, a.mpos, a.mchrom, a.rg, a.tlen, [tuple(c) for c in a.cigar]) == (100, 150, "c", "g1", 100, [("M", 10), ("N", 5), ("M", 10)])
    assert b.chrom is None and b.mchrom is None and b.cigar == [] and tuple(sizes.first()) == ("c", 0, 1000)


def test_bedgraph_round_trip(spark, tmp_path):
    sizes = spark.createDataFrame([("b", 0, 100), ("a", 1, 100)], "chrom string, ord int, length long")
    rows = [("a", 0, 10, 1.5), ("b", 5, 7, 1e-7), ("b", 7, 20, 1234567.0), ("a", 10, 12, 0.0)]
    S.write_bedgraph(spark.createDataFrame(rows, "chrom string, start long, end long, value double"), sizes, str(tmp_path / "out"), compress=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ["a\t0\t10\t1.5", "a\t10\t12\t0", "b\t5\t7\t1e-07", "b\t7\t20\t1.23457e+06"]
    assert S.read_bedgraph(spark, str(tmp_path / "out")).count() == 4


def test_matrix_round_trip(spark, tmp_path):
    head = '@{"upstream":[10],"downstream":[0],"body":[0],"bin size":[5],"ref point":["TSS"],"unscaled 5 prime":[0],"unscaled 3 prime":[0],"group_labels":["g","h"],"group_boundaries":[0,1,2],"sample_labels":["s"],"sample_boundaries":[0,2]}\n'
    body = "c\t1,9\t5,12\tx\t0.0\t+\t1.500000\tnan\nc\t1\t5\ty\t.\t-\t-2.000000\tinf\n"
    header, rows = S.read_matrix(spark, write(tmp_path, "m.mat.gz", head + body, True))
    found = {r.name: r for r in rows.collect()}
    assert found["x"].bins == [1.5, None] and found["y"].bins == [-2.0, None] and (found["x"].group_id, found["y"].group_id) == (0, 1) and found["y"].score is None
    S.write_matrix(S.matrix_header(header, rows, ["g", "h"], ["s"]), rows, str(tmp_path / "out"))
    again, same = S.read_matrix(spark, str(next((tmp_path / "out").glob("part-00000*"))))[0], "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert again["group_boundaries"] == [0, 1, 2] and "c\t1,9\t5,12\tx\t0.0\t+\t1.500000\tnan" in same and "y\t.\t-\t-2.000000\tnan" in same
    assert [r.value for r in S.value_table(rows).collect()] == ["1.5\tnan", "-2\tnan"]
    assert S.sorted_regions(rows, ["g", "h"]).first().value == "c\t1\t12\tx\t0.0\t+\t1\t12\t0\t2\t4,3\t0,8\tg"
    assert S.profile_table(P.profile(rows), ["g", "h"], ["s"]).collect()[0].value == "s\tg\tcentre\t1.5\tnan"
    with pytest.raises(ValueError):
        S.check_header(header | {"sample_boundaries": [0, 0]})
    with pytest.raises(ValueError):
        S.check_header(header | {"upstream": [1000]})


def test_gtf_groups(spark, tmp_path):
    """Regions are grouped by an attribute in order of its first occurrence; rows without it have the default group."""
    kinds = ["lnc", "coding", None, "lnc", "pseudo", "coding"]
    lines = [f'c\tx\ttranscript\t{10 * i + 1}\t{10 * i + 9}\t.\t+\t.\ttranscript_id "t{i}";' + (f' kind "{k}";' if k else "") for i, k in enumerate(kinds)]
    path = write(tmp_path, "a.gtf", "#!x\n" + "\n".join(lines) + "\n")
    got = {r.name: (r.group, r.group_id) for r in S.read_gtf(spark, path, group="rest", group_attribute="kind").collect()}
    order = ["lnc", "coding", "rest", "pseudo"]
    assert got == {f"t{i}": (k or "rest", order.index(k or "rest")) for i, k in enumerate(kinds)}
    assert {(r.group, r.group_id) for r in S.read_gtf(spark, path).collect()} == {("genes", 0)}


def judged(row, statistic, nan_mode, action, low, high, gated, inclusive):
    """One row's samples after a filter, or None where it goes: the policy in plain words."""
    outside = lambda v: v <= low or v >= high if inclusive else v < low or v > high
    failed = []
    for s, bins in enumerate(row):
        here = [v for v in bins if math.isfinite(v)]
        tested = here if statistic == "perBin" else [{"mean": np.mean, "median": np.median, "sum": np.sum, "min": min, "max": max}[statistic](here)] if here else []
        lacking = nan_mode == "any_bin" and len(here) < len(bins) or nan_mode == "any_sample" and not here
        failed.append(s in gated and (lacking or any(map(outside, tested))))
    if nan_mode == "all_bins" and not any(math.isfinite(v) for s in gated for v in row[s]):
        failed = [s in gated for s in range(len(row))]
    if action == "remove":
        return None if any(failed) else [[v if math.isfinite(v) else None for v in bins] for bins in row]
    return [[None if f or not math.isfinite(v) else v for v in bins] for f, bins in zip(failed, row)]


def test_filter_policy(spark):
    """Random rows, missing and infinite bins among them, under every statistic, missing-value mode and action."""
    rng = random.Random(8)
    value = lambda: rng.choice([math.nan, math.inf, -math.inf, 0.0, 5.0, -2.0, 2.0**50, *(float(rng.randint(-1, 6)) for _ in range(9))])
    rows = [[[math.nan if rng.random() < 0.15 else value() for _ in range(n)] if rng.random() < 0.9 else [math.nan] * n for n in (2, 4, 1, 3)] for _ in range(60)]
    m = X.stored(spark.createDataFrame([(r, 0, r, s, bins) for r, row in enumerate(rows) for s, bins in enumerate(row)], "row_id long, group_id int, ord long, sample int, bins array<double>")).cache()
    for k, (statistic, nan_mode) in enumerate((s, n) for s in X.FILTER_STATISTICS for n in X.NAN_MODES):
        action, gated, inclusive = ("remove", "mask")[k % 2], ([0, 1, 2, 3], [1], [0, 3])[k % 3], k % 5 == 0
        got = {}
        for r in X.filter_values(m, -2, 5, statistic, nan_mode, gated, action, inclusive).collect():
            got.setdefault(r.row_id, {})[r.sample] = r.bins
        want = {r: dict(enumerate(left)) for r, row in enumerate(rows) if (left := judged(row, statistic, nan_mode, action, -2, 5, gated, inclusive))}
        assert got == want, (statistic, nan_mode, action)
    kept = {r.row_id for r in X.skip_zeros(m).select("row_id").distinct().collect()}
    assert kept == {r for r, row in enumerate(rows) if any(math.isfinite(v) and v for bins in row for v in bins)}


def test_combine_keeps_the_rows_of_the_first(spark):
    schema = "row_id long, group_id int, ord long, sample int, bins array<float>, name string"
    first = spark.createDataFrame([(1, 0, 0, 0, [1.0, None], "a"), (2, 0, 1, 0, [None, 4.0], "b"), (3, 1, 0, 0, [5.0, 6.0], "a")], schema)
    other = spark.createDataFrame([(7, 0, 0, 0, [3.0, None], "a"), (1, 1, 0, 0, [None, 2.0], "a"), (9, 0, 5, 0, [9.0, 9.0], "z")], schema)
    got = X.combine([first, other], "mean", ["name"])
    assert got.columns == first.columns and {(r.row_id, r.ord): r.bins for r in got.collect()} == {(1, 0): [2.0, None], (2, 1): [None, 4.0], (3, 0): [5.0, 4.0]}
    assert {r.row_id: r.bins for r in X.combine([first, other, first], "sum").collect()} == {1: [2.0, 2.0], 2: [None, 8.0], 3: [10.0, 12.0]}
    with pytest.raises(Exception, match="more than once"):
        X.combine([first, other.unionByName(other)], "mean", ["name"]).collect()


def test_sort_rules(spark):
    m = spark.createDataFrame([(r, 0, r, 0, b) for r, b in enumerate([[1.0], [None], [3.0], [1.0], [2.0]])], "row_id long, group_id int, ord long, sample int, bins array<float>")
    order = lambda *a, **k: [r.row_id for r in X.sort_order(m, *a, **k).orderBy("out_group", "out_pos").collect()]
    assert order("mean", "ascend") == [0, 3, 4, 2, 1] and order("mean", "descend") == [1, 2, 4, 0, 3]
    assert [r.out_group for r in X.sort_order(m, "mean", "ascend", quantiles=2).orderBy("out_group", "out_pos").collect()] == [0, 0, 1, 1, 1]
    many = spark.createDataFrame([(r, r % 2, r, 0, [None if r % 11 == 0 else float(r * 7 % 13)]) for r in range(300)], "row_id long, group_id int, ord long, sample int, bins array<float>")
    for method in ("ascend", "descend", "keep"):
        for q in (1,) if method == "keep" else (1, 4):
            one, cut = ({tuple(r) for r in X.sort_order(many, "mean", method, q, per_task=n).collect()} for n in (1000, 20))
            assert one == cut and len(one) == 300
    assert X.relabel(["a", "b"], {"2": "c"}) == ["a", "c"] and X.pseudocount_spec("min-numerator/2") == ("min", "numerator", 2.0) and X.pseudocount_spec("0.5")[2] == 0.5
    assert X.pseudocount_spec("MIN-denominator") == ("min", "denominator", 1.0) and X.pseudocount_spec("max-numerator/1e-3") == ("max", "numerator", 0.001) and X.pseudocount_spec("-2e1") == ("number", None, -20.0)
    for wrong in ("min-numerator/0", "mean-numerator", "min-numerator/", "inf", "min-numerator/nan", "max", ""):
        with pytest.raises(ValueError):
            X.pseudocount_spec(wrong)


def test_clusters(spark):
    rows = [(i, 0, i, 0, [float(10 * (i % 3)), float(i % 3), 0.1 * i]) for i in range(30)]
    vectors = clusters.row_vectors(spark.createDataFrame(rows, "row_id long, group_id int, ord long, sample int, bins array<float>"))
    for out in (clusters.kmeans(vectors, 3, restarts=2), clusters.ward(vectors, 3)):
        assert {(r.row_id % 3, r.cluster, r.name) for r in out.collect()} == {(2, 0, "cluster_1"), (1, 1, "cluster_2"), (0, 2, "cluster_3")}
    score = clusters.silhouettes(clusters.ward(vectors, 3)).agg(F.min("silhouette"), F.count("*")).first()
    assert score[0] > 0.7 and score[1] == 30


def test_bands(spark):
    assert abs(P.student_t(0.975, 10) - 2.2281388519649385) < 1e-9 and abs(P.student_t(0.975, 1) - 12.706204736432095) < 1e-6
    m = spark.createDataFrame([(r, 0, r, 0, [float(r), None]) for r in range(8)], "row_id long, group_id int, ord long, sample int, bins array<float>")
    band = {r.bin: r for r in P.bootstrap(m, resamples=100).collect()}
    assert band[0].lower < 3.5 < band[0].upper and band[1].centre is None and band[1].lower is None
    ci = {r.bin: r for r in P.profile(m, band="ci").collect()}
    assert ci[0].upper > band[0].upper and ci[1].centre is None
    with pytest.raises(Exception, match="one sign"):
        P.profile(m.withColumn("bins", F.array(F.col("ord") - 3.0, F.lit(1.0)).cast("array<float>")), "geom_mean").collect()


def test_ward_from_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6)) + 4 * rng.integers(0, 3, (700, 1))
    want, got = clusters.ward_tree(x), clusters.ward_tree_of_vectors(x, block=64)
    assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert len(clusters.ward_tree_of_vectors(np.ones((50, 2)))) == 49 and clusters.ward_tree_of_vectors(x[:1]) == []
    monkeypatch.setattr(clusters, "WARD_ROWS", 100)
    vectors = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "row_id long, ord long, x array<double>")
    named = {r.row_id: r.cluster for r in clusters.ward(vectors, 3).collect()}
    label = clusters.cut(want, 700, 3)
    assert len({(named[i], label[i]) for i in range(700)}) == 3 and len(named) == 700


def test_ward_query_reads_all_rows(spark, tmp_path):
    from tracklake.plans import catalog

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist(), i % 3) for i in (*range(40), *range(2000, 2040))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.row_id for r in catalog.QUERIES["clusters_by_ward"](spark, str(tmp_path)).collect()} == {i for i, _, _ in rows}


def test_cluster_and_bootstrap_queries_use_defaults(spark, monkeypatch):
    import inspect

    from tracklake.plans import catalog

    sf, seen = "/root/testdata/sf0.001", {}
    for module, name, of in ((clusters, "kmeans", "restarts"), (P, "bootstrap", "resamples")):
        whole = getattr(module, name)

        def spy(*given, _whole=whole, _name=name, _of=of, **named):
            seen[_name] = inspect.signature(_whole).bind(*given, **named)
            seen[_name].apply_defaults()
            seen[_name] = seen[_name].arguments[_of]
            return spark.createDataFrame([(1, 1, "x")], "row_id long, cluster int, name string")

        monkeypatch.setattr(module, name, spy)
    catalog.QUERIES["clusters_by_kmeans"](spark, sf), catalog.QUERIES["profile_bootstrap"](spark, sf)
    assert seen == {"kmeans": 20, "bootstrap": 300}


def test_matrix_text_rounds_ties_to_even(spark):
    values = [-0.0703125, 0.0078125, 0.0234375, 1.5, -1e-7, 0.0, -0.0, 123456.7890625, 0.1, None, float("nan"), float("inf"), float("-inf")]
    m = spark.createDataFrame([(1, 0, 1, 0, values, "c", [(0, 1)], "n", None, ".")], f"row_id long, group_id int, ord long, sample int, bins array<float>, chrom string, blocks {S.BLOCKS}, name string, score double, strand string")
    want = ["nan" if v is None else f"{float(np.float32(v)):.6f}" for v in values]
    assert S.matrix_lines(m).first().line.split("\t")[6:] == want and want[:2] == ["-0.070312", "0.007812"]


def test_kmeans_starts_share_passes(spark, monkeypatch):
    """In one task or over blocks the best of the starts is the same; it is a fixed point and no worse than any start alone."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 5)) + 3 * rng.integers(0, 4, (400, 1))
    vectors = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "row_id long, ord long, x array<double>").repartition(4)
    held = {}
    for limit in (1 << 20, 1):
        monkeypatch.setattr(clusters, "HELD", limit)
        held[limit] = {r.row_id: r.cluster for r in clusters.kmeans(vectors, 4, restarts=6).collect()}
    assert held[1] == held[1 << 20] and len(held[1]) == 400
    label = np.array([held[1][i] for i in range(400)])
    centres = np.array([x[label == c].mean(0) for c in range(4)])
    d = ((x[:, None] - centres) ** 2).sum(2)
    assert (d.argmin(1) == label).all()
    passes = []
    monkeypatch.setattr(clusters, "_totals", lambda x, c, _whole=clusters._totals: passes.append(c.shape) or _whole(x, c))
    hashes = np.arange(400, dtype=np.uint64)
    best, _ = clusters._best_centres(lambda c, s: clusters._drawn(x, hashes, c, s), lambda c: clusters._totals(x, c), 5, 4, list(range(6)), 300, 1e-5)
    assert passes[0][0] == passes[-1][0] == 6 and len(passes) < 302 and ((x[:, None] - best) ** 2).sum(2).min(1).sum() <= d.min(1).sum() * 1.2
    same = vectors.withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.cluster for r in clusters.kmeans(same, 3).collect()} == {0} and clusters.kmeans(same.limit(0), 3).count() == 0


def test_ward_nearest_in_single_precision():
    """The nearest cluster is that of double precision, among near ties, equal rows and sizes."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(200, 6)), 1 + 1e-7 * rng.normal(size=(60, 6)), np.ones((40, 6))])
    size, alive = rng.integers(1, 4, 300).astype(float), np.arange(0, 300, 2)
    d = ((x[alive][:, None] - x[alive][None]) ** 2).sum(2) * 2 / (1 / size[alive][:, None] + 1 / size[alive][None])
    np.fill_diagonal(d, np.inf)
    near, far = clusters._nearest(x, size, alive, alive, tile=32)
    assert (near != alive).all() and np.allclose(far, d.min(1), rtol=1e-9, atol=1e-13) and (near[:100] == alive[d.argmin(1)][:100]).all()
