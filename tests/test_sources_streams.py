import pytest
from pyspark.sql import functions as F

from catalogue.spark_queries import _event_stream
from log_templates.operators.match import match_templates
from log_templates.plans.mine import ParseOptions
from log_templates.sources import formats, readers, sinks
from log_templates.streaming import stream
from log_templates.tables import Scratch

FAST = ParseOptions(clustering="token_key", sample_method="random")

SAMPLES = {
    "HDFS": ("081109 203615 148 INFO dfs.DataNode: got block", "got block"),
    "Zookeeper": ("2015-07-29 17:41:44,747 - INFO  [QuorumPeer:Leader@1] - started", "started"),
    "Linux": ("Jun 14 15:16:01 combo sshd(pam_unix)[19939]: failed", "failed"),
    "Mac": ("Jul  1 09:00:55 host kernel[0] (com.x): waking", "waking"),
    "HealthApp": ("20171223|Step|300|count 1", "count 1"),
    "Apache": ("[Sun Dec 04] [notice] ready  now", "ready  now"),
}


def test_formats_of_all_systems(spark):
    assert len(formats.LOG_FORMATS) == 16
    rows = [(s, line) for s, (line, _) in SAMPLES.items()] + [("HDFS", "no header")]
    df = spark.createDataFrame(rows, "system string, value string")
    multi = {r["system"]: r["content"] for r in formats.extract_headers_multi(df).collect()}
    assert multi == {s: c for s, (_, c) in SAMPLES.items()}
    for system, (_, content) in SAMPLES.items():
        one = formats.extract_headers(df.where(F.col("system") == system), formats.LOG_FORMATS[system]).collect()
        assert [r["content"] for r in one] == [content]
    linux = formats.extract_headers(df.where("system = 'Linux'"), formats.LOG_FORMATS["Linux"]).first()
    assert (linux["pid"], linux["component"]) == ("19939", "sshd(pam_unix)")


def test_raw_and_structured_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("[t1] [info]  first line \nbroken\n[t2] [warn] second\n")
    raw = readers.read_raw_logs(spark, str(tmp_path / "a.log"), formats.LOG_FORMATS["Apache"])
    assert [r["content"] for r in raw.orderBy("line_id").collect()] == ["first line", "second"]
    assert readers.read_raw_logs(spark, str(tmp_path / "a.log")).count() == 3
    (tmp_path / "s.csv").write_text('LineId,Content,EventId,EventTemplate\n1,"say ""hi"", null",E1,"say <*>, null"\n2,null,E2,\n')
    rows = readers.read_structured_logs(spark, str(tmp_path / "s.csv")).orderBy("line_id").collect()
    assert rows[0]["content"] == 'say "hi", null' and rows[0]["event_template"] == "say <*>, null"
    assert rows[1]["content"] == "null" and rows[1]["event_template"] is None
    (tmp_path / "t.csv").write_text("EventID,EventTemplate,Occurrence\nE1,a <*>,3\n")
    assert readers.read_templates(spark, str(tmp_path / "t.csv")).first().asDict() == {
        "event_id": "E1", "event_template": "a <*>", "occurrence": 3,
    }


def test_sinks_round_trip(spark, tmp_path):
    parsed = spark.createDataFrame([(1, 'a "x", y', "a <*>")], "line_id bigint, content string, event_template string")
    sinks.write_parsed(parsed, str(tmp_path / "p"), "csv")
    back = readers.read_structured_logs(spark, str(tmp_path / "p")).first()
    assert (back["content"], back["event_template"]) == ('a "x", y', "a <*>")
    path = str(tmp_path / "runs")
    sinks.append_run_metrics(spark, path, "x", 1.0, 2.0)
    sinks.append_run_metrics(spark, path, "x", 0.5, 1.23456)
    runs = sinks.read_run_metrics(spark, path).collect()
    assert [(r["dataset"], r["invocation_time"], r["parsing_time"]) for r in runs] == [("x", 0.5, 1.235)]


def files_of(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, "line_id bigint, content string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("line_id bigint, content string").option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


BATCHES = [
    [(i, f"task {i} done by w{i}x{i}") for i in range(100, 112)],
    [(i, f"task {i} done by w{i}x{i}") for i in range(112, 120)] + [(1, "shutting down"), (2, "shutting down")],
]


@pytest.mark.parametrize("bound", [50_000, 0])
def test_stream_match_equals_batch_match(spark, tmp_path, bound):
    templates = spark.createDataFrame(
        [(1, "task <*> done by <*>", "task 1 done by w", 1)],
        "template_id bigint, event_template string, reference_log string, hits bigint",
    )
    matched = stream.stream_match(files_of(spark, tmp_path, BATCHES), templates, max_lookup_rows=bound)
    out = str(tmp_path / "out")
    run(matched.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out))
    batch = match_templates(spark.read.parquet(str(tmp_path / "in")), templates)
    key = lambda df: sorted((r["line_id"], r["event_template"] or "") for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch)


def test_stream_parse_learns_and_replays(spark, tmp_path):
    known, out = str(tmp_path / "known"), str(tmp_path / "parsed")
    run(stream.stream_parse(files_of(spark, tmp_path, BATCHES), known, out, str(tmp_path / "c"), FAST))
    parsed = stream.read_parsed_stream(spark, out)
    assert parsed.count() == 22
    table = {r["event_template"]: r["hits"] for r in stream.read_stream_templates(spark, known).collect()}
    assert sum(table.values()) == 22 and table["shutting down"] == 2
    last = spark.createDataFrame(BATCHES[1], "line_id bigint, content string")
    stream.parse_batch(last, 1, known, out, FAST)
    again = {r["event_template"]: r["hits"] for r in stream.read_stream_templates(spark, known).collect()}
    assert stream.read_parsed_stream(spark, out).count() == 22 and sum(again.values()) == 22


def test_snapshots_bound_what_a_batch_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream, "SNAPSHOT_EVERY", 3)
    known, out = str(tmp_path / "known"), str(tmp_path / "parsed")
    rows = lambda n: [(100 * n + k, f"task {100 * n + k} done by w{k}x{k}") for k in range(6)] + [(100 * n + 99, f"only {'ab'[n % 2]}")]
    for n in range(8):
        stream.parse_batch(spark.createDataFrame(rows(n), "line_id bigint, content string"), n, known, out, FAST)
        assert len(list((tmp_path / "known").glob("*=*"))) <= 2 + 2 * 3
    table = {r["event_template"]: r["hits"] for r in stream.read_stream_templates(spark, known).collect()}
    assert sum(table.values()) == 56 and table["only a"] == 4
    for n in (5, 7):  # a replayed batch reads what it read before
        before = {r["event_template"]: r["hits"] for r in stream.read_stream_templates(spark, known, n).collect()}
        assert sum(before.values()) == 7 * n
        stream.parse_batch(spark.createDataFrame(rows(n), "line_id bigint, content string"), n, known, out, FAST)
    again = {r["event_template"]: r["hits"] for r in stream.read_stream_templates(spark, known).collect()}
    assert again == table and stream.read_parsed_stream(spark, out).count() == 56


def test_streams_keep_systems_apart(spark, tmp_path):
    known, out = str(tmp_path / "known"), str(tmp_path / "parsed")
    rows = [(k, "xy"[k % 2], f"job {k} of {'xy'[k % 2]} ended") for k in range(20)]
    frame = spark.createDataFrame(rows, "line_id bigint, dataset string, content string")
    for n in range(2):
        stream.parse_batch(frame, n, known, out, FAST, ["dataset"])
    got = stream.read_stream_templates(spark, known, by=["dataset"]).collect()
    assert {(r["dataset"], r["event_template"], r["hits"]) for r in got} == {
        ("x", "job <*> of x ended", 20), ("y", "job <*> of y ended", 20)
    }


def test_corrected_truth_round_trip(spark, tmp_path):
    rows = [(1, "user 7 in", "E10", "user 7 in"), (2, "user 8 in", "E2", "user 8 in"), (3, "x", "E1", "x"), (4, "x", "E1", "x")]
    lines = spark.createDataFrame(rows, "line_id bigint, content string, event_id string, event_template string")
    sinks.write_corrected(lines, str(tmp_path / "log"), str(tmp_path / "table"))
    back = readers.read_structured_logs(spark, str(tmp_path / "log")).orderBy("line_id").collect()
    assert [(r["event_id"], r["event_template"]) for r in back] == [("E10", "user <*> in")] * 2 + [("E1", "x")] * 2
    table = spark.read.csv(str(tmp_path / "table"), header=True).collect()
    assert [(r["EventId"], r["EventTemplate"], r["Occurrences"]) for r in table] == [("E1", "x", "2"), ("E10", "user <*> in", "2")]


def test_replayed_batches_keep_several_cores_busy(spark, tmp_path):
    """A batch of one file is written and matched by one task, however large it is."""
    made = spark.range(40_000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("props"))
    made.write.parquet(str(tmp_path / "events.parquet"))
    batches = {}

    def look(batch, batch_id):
        batches[batch_id] = [(r["f"], r["n"]) for r in batch.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]

    replay = _event_stream(spark, str(tmp_path), Scratch(spark, "replay"))
    replay.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(look).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 4 and all(len(files) > 1 for files in batches.values())
    assert sum(n for files in batches.values() for _, n in files) == 40_000
