"""Files in, files out; the request loop; streams."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tracklake.functions import labels
from tracklake.operators import coverage as C
from tracklake.operators import matrix_build as B
from tracklake.plans import fixtures, programs, service
from tracklake.sources import bigwig, text
from tracklake.streaming import arrivals

SF = "/root/testdata/sf0.001"


def test_files_to_matrix(spark, tmp_path):
    sam = "@SQ\tSN:c\tLN:1000\n" + "".join(f"r{i}\t{16 if i % 2 else 0}\tc\t{i * 3 + 1}\t60\t30M\t*\t0\t0\t*\t*\n" for i in range(200))
    (tmp_path / "a.sam").write_text(sam)
    (tmp_path / "r.bed").write_text("c\t100\t200\tx\t0\t+\nc\t300\t420\ty\t0\t-\n#One\nc\t900\t990\tz\t0\t+\n")
    out = str(tmp_path / "a.bw")
    programs.coverage(spark, str(tmp_path / "a.sam"), out, C.Coverage(bin_size=10, aggregation="count"))
    assert bigwig.read_bigwig(spark, out).agg(F.sum(F.col("end") - F.col("start"))).first()[0] == 1000
    assert not [p for p in tmp_path.iterdir() if ".part" in p.name]
    programs.coverage(spark, str(tmp_path / "a.sam"), str(tmp_path / "s.bw"), C.Coverage(bin_size=10, library="forward", strand="split"))
    assert (tmp_path / "s.plus.bw").exists() and (tmp_path / "s.minus.bw").exists()
    programs.track_merge(spark, [out, str(tmp_path / "s.plus.bw")], str(tmp_path / "m.bw"), 20, "mean")
    programs.track_scale(spark, out, str(tmp_path / "x.bw"), -2.0)
    assert programs.track_info(spark, [str(tmp_path / "x.bw")]).first()["max"] == 0
    m = programs.compute_matrix(spark, [out], [str(tmp_path / "r.bed")], B.Layout(upstream=20, downstream=50, bin_size=10), skip_zeros=True)
    programs.save_matrix(m, str(tmp_path / "m.tab"))
    part = str(next((tmp_path / "m.tab").glob("part-*")))
    again = programs.load_matrix(spark, part)
    assert again.groups == ["One", "genes"] or again.groups == m.groups
    assert {r.name: r.bins for r in again.rows.collect()} == {r.name: r.bins for r in m.rows.collect()} and programs.describe(again)["geometry"]["upstream"] == [20]
    twice = programs.transform(programs.bind_columns(m, m), [("scale", 2.0), ("add", 1.0)])
    assert twice.samples == ["a", "a_r1"] and twice.rows.select("sample").distinct().count() == 2 and twice.header["history"] == [["scale", 2.0], ["add", 1.0]]
    stacked = programs.bind_rows([m, m])
    assert stacked.groups == m.groups and stacked.rows.count() == 2 * m.rows.count()
    ready, _ = programs.prepare(m, programs.Preparation(sort="descend", quantiles=2))
    assert ready.rows.select("group_id").distinct().count() == 2 and ready.groups[0].endswith("_Q1")
    with pytest.raises(ValueError), programs.published(out, inputs=(out,)):
        pass
    with pytest.raises(ValueError):
        programs.transform(m, [("sqrt",)])


def test_track_formats(spark, tmp_path):
    """The format comes from the option or the name, and the file is in it, under its staged name too."""
    named = {"o.bw": ("bigwig", False), "o.bg": ("bedgraph", False), "o.bedGraph": ("bedgraph", False), "o.bg.gz": ("bedgraph", True), "o.part": ("bigwig", False), "o.gz": ("bigwig", False)}
    assert {n: programs.track_format(n) for n in named} == named and programs.track_format("o.txt", "bedgraph") == ("bedgraph", False)
    with pytest.raises(ValueError):
        programs.track_format("o.bw", "wig")
    (tmp_path / "a.sam").write_text("@SQ\tSN:c\tLN:100\n" + "".join(f"r{i}\t0\tc\t{i * 9 + 1}\t60\t10M\t*\t0\t0\t*\t*\n" for i in range(9)))
    spec = C.Coverage(bin_size=10, aggregation="count")
    want = None
    for name, given in (("o.bw", None), ("o.bg", None), ("o.bedGraph", None), ("o.bg.gz", None), ("plain.txt", "bedgraph")):
        out = str(tmp_path / name)
        programs.coverage(spark, str(tmp_path / "a.sam"), out, spec, format=given)
        bedgraph = (given or programs.track_format(name)[0]) == "bedgraph"
        rows = text.read_bedgraph(spark, out, 0) if bedgraph else bigwig.read_bigwig(spark, out)
        found = sorted((r.chrom, r.start, r.end, r.value) for r in rows.filter("value <> 0").collect())
        want = want or found
        assert found == want and len(found) > 1
        if not bedgraph:
            with open(out, "rb") as f:
                assert f.read(4) == bytes.fromhex("26fc8f88")
    programs.coverage(spark, str(tmp_path / "a.sam"), str(tmp_path / "s.bg.gz"), C.Coverage(bin_size=10, library="forward", strand="split"))
    assert (tmp_path / "s.plus.bg.gz").exists() and (tmp_path / "s.minus.bg.gz").exists()


def test_outputs_roll_back(tmp_path):
    (tmp_path / "a").write_text("old")
    with pytest.raises(RuntimeError), programs.published(str(tmp_path / "a"), str(tmp_path / "b")) as (a, _):
        with open(a, "w") as f:
            f.write("new")
        raise RuntimeError
    assert (tmp_path / "a").read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["a"]
    (tmp_path / "o.json").write_text('{"a": {"b": 1}}')
    assert programs.merged_options({"a": {"b": 2, "c": 3}}, programs.options_file(str(tmp_path / "o.json")), {"d": None}) == {"a": {"b": 1, "c": 3}, "d": None}
    assert programs.options_file(str(tmp_path / "none")) == {}


def test_service(spark):
    out: list[str] = []
    requests = [{"id": 1, "command": "info"}, {"id": 2, "command": "query", "name": "data_range", "sf": SF}, {"id": 3, "command": "nothing"}, {"id": 4, "command": "describe", "path": "/none"}, {"command": "close"}]
    service.serve(spark, [json.dumps(requests[0]), "broken", *map(json.dumps, requests[1:])], out.append)
    answers = [json.loads(x) for x in out]
    assert "data_range" in answers[0]["result"]["queries"] and "error" in answers[1] and len(answers[2]["result"]) == 4 and all("error" in a for a in answers[3:5]) and len(answers) == 5
    s = service.Service(spark)
    s.cancel(9)
    assert s.answer({"id": 9, "command": "info"}) == {"id": 9, "error": "cancelled"} and threading.active_count() > 0


def test_stream_equals_batch(spark, tmp_path):
    rows = fixtures.alignments(spark, SF).withColumn("length", F.lit(fixtures.LENGTH).cast("long"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    spec = C.Coverage(aggregation="count", min_mapq=10)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = arrivals.bin_counts(stream, spec).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.chrom, r.bin): r.total for r in spark.table("bins").collect()}
    want = {(r.chrom, r.bin): r.value for r in C.binned(fixtures.alignments(spark, SF), fixtures.sizes(spark), spec).collect()}
    assert got == want
    assert text is not None


def test_labels():
    assert labels.file_label("/a/b.c.bw") == "b.c" and labels.unique_labels(["a", "b", "a", "a"]) == ["a", "b", "a_r1", "a_r2"]
    assert labels.unescape(r"a\nb\\t") == "a\nb\\t" and labels.escape("a\tb") == "a\\tb"
    assert labels.assignments(["1-2=x", "4=y"], 4) == {0: "x", 1: "x", 3: "y"} and labels.assignments(["a", "b"], 3) == {0: "a", 1: "b", 2: "a"}
    assert labels.real_number("1e-3") == 0.001 and labels.whole_number("7") == 7 and labels.distance_unit(5000) == ("kb", 1000.0)
    assert labels.distance_ticks(1000, 0, 2000, 10) == [(0.0, "-1 kb"), (100.0, "anchor"), (300.0, "2 kb")]
    for bad in ("1e-400", "nan", "x", "1e39"):
        with pytest.raises(ValueError):
            labels.real_number(bad)
    with pytest.raises(ValueError):
        labels.places_of("0-2", 4)
