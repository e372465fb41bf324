"""Sources, sinks, session folder and late events."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
import zstandard
from pyspark.sql import functions as F

from shelfspark import cli, session
from shelfspark.sources import files, tables
from shelfspark.streaming import events as E


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_checkpoints_are_kept_in_the_configured_folder(spark):
    assert session.cut(spark.range(3)).count() == 3 and session.shared_dir(spark).startswith("file:")


def test_json_lines(spark, tmp_path):
    rows = [{"id": 1, "v": "b", "type": "product"}, {"id": 1, "v": "a", "type": "product"}, {"id": 2, "v": "x", "type": "error"}]
    text = "\n".join(map(json.dumps, rows)) + "\n"
    spark.createDataFrame([json.dumps(r) for r in rows], "string").write.option("compression", "gzip").text(str(tmp_path / "gzip"))
    (tmp_path / "zstd").mkdir()
    packer = zstandard.ZstdCompressor()
    (tmp_path / "zstd/a.jsonl.zst").write_bytes(packer.compress(text[:60].encode()) + packer.compress(text[60:].encode()))  # two frames
    for codec in ("gzip", "zstd"):
        got = files.read_json_lines(spark, str(tmp_path / codec), "id long, v string, type string", "product", ["id"], zstd=codec == "zstd")
        assert [(r.id, r.v) for r in got.collect()] == [(1, "a")]


def test_digests_are_verified(spark, tmp_path):
    for n in "abc":
        (tmp_path / n).write_text(n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = spark.createDataFrame([("a", sha("a")), ("b", sha("x")), ("d", sha("d"))], "name string, sha256 string")
    assert {tuple(r) for r in files.verify(spark, str(tmp_path), expected).collect()} == {("b", "differs"), ("c", "not expected"), ("d", "missing")}


def test_qrels_files(spark, tmp_path):
    rows = [("test", "us", q, f"us:{d}", 3 - d % 4) for q in range(3) for d in range(4)] + [("dev", "es", 9, "es:1", 0)]
    files.write_qrels(spark.createDataFrame(rows, "split string, locale string, query_id long, doc_id string, grade long"), str(tmp_path / "q"))
    lines = [x for f in sorted((tmp_path / "q/split=test/locale=us").glob("*.txt")) for x in f.read_text().splitlines()]
    assert len(lines) == 12 and lines == sorted(lines) and "0 0 us:1 2" in lines


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("<c>", None)], "name string, n long")
    assert "| a\\|b | 1 |" in files.write_report(df, str(tmp_path / "r.md"), "t") and "&lt;c&gt;" in files.write_report(df, str(tmp_path / "r.html"), "t")
    files.write_report(df, str(tmp_path / "r.jsonl"), "t")
    assert [json.loads(x)["n"] for x in (tmp_path / "r.jsonl").read_text().splitlines()] == [1, None]
    with pytest.raises(ValueError):
        files.write_report(spark.range(20), str(tmp_path / "x.md"), "t", most=10)


def test_stage_and_command_line(spark, tmp_path, capsys):
    made = files.write_stage(spark.range(1000), str(tmp_path / "s"), "s")
    assert made["rows"] == 1000 and made["bytes"] > 0 and made["rows_per_second"] > 0
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert cli.main(["run", "label_gains", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["stage"] == "label_gains"
    assert cli.main(["report", "label_gains", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "l.md")]) == 0
    assert (tmp_path / "l.md").read_text().startswith("# label_gains")


def test_subset(spark):
    assert tables.subset(spark.range(1).withColumn("b", F.lit(1)), ["b", "x", "id"]).columns == ["b", "id"]


def test_late_events_are_left_out(spark, tmp_path):
    """A window comes out once, and an event behind the watermark doesn't change it."""
    start = datetime(2024, 1, 1)
    first = [(1, start + timedelta(minutes=m), "a", 1.0) for m in (1, 5, 200)]
    late = [(2, start + timedelta(minutes=7), "a", 1.0), (3, start + timedelta(minutes=400), "a", 1.0)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    state, out = str(tmp_path / "state"), str(tmp_path / "out")

    def run():
        made = E.tumbling(E.read_events(spark, str(tmp_path)), "ts", "1 hour", "10 minutes", "event_type")
        made.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start().awaitTermination()

    run()
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    run()
    got = sorted((r.n, r.total) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1.0), (2, 2.0)]
