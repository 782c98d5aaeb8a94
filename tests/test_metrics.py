import pytest
from pyspark.sql import functions as F

from log_templates.operators import correction, metrics
from log_templates.plans import evaluate

SCHEMA = "dataset string, line_id bigint, truth string, parsed string"


def scored(spark, rows, **options):
    df = spark.createDataFrame(rows, "truth string, parsed string")
    return metrics.all_metrics(metrics.pair_counts(df), **options).first()


def test_perfect_parse(spark):
    got = scored(spark, [("a <*>", "a <*>")] * 3 + [("b", "b")])
    for name in ("ga", "pga", "rga", "fga", "pa", "pta", "rta", "fta", "ned", "sa"):
        assert got[name] == 1.0
    assert got["ed"] == 0.0 and (got["identified"], got["ground_truth"]) == (2, 2)


def test_split_group(spark):
    got = scored(spark, [("a <*>", "a <*>")] * 2 + [("a <*>", "a 1")] + [("b", "b")])
    assert got["ga"] == pytest.approx(1 / 4)
    assert got["pa"] == pytest.approx(3 / 4)
    assert got["pta"] == pytest.approx(2 / 3) and got["rta"] == 1.0
    assert got["pga"] == pytest.approx(1 / 3) and got["rga"] == pytest.approx(1 / 2)


def test_unknown_truth_counts_for_pa_only(spark):
    got = scored(spark, [("a", "a"), (None, "a"), ("b", "")])
    assert got["pa"] == pytest.approx(1 / 3)
    assert got["ga"] == 1.0 and got["ned"] == pytest.approx(0.5)


def test_list_of_templates(spark):
    rows = [("a", "a")] * 2 + [("b", "x")] + [("c", "x")]
    wanted = spark.createDataFrame([("a",), ("b",), ("never",)], "event_template string")
    got = scored(spark, rows, wanted=wanted)
    assert got["ga"] == pytest.approx(2 / 3) and got["pa"] == pytest.approx(2 / 3)
    assert got["pga"] == pytest.approx(1 / 2) and got["rga"] == pytest.approx(1 / 3)
    assert (got["identified"], got["ground_truth"]) == (2, 3)


def test_tokens_are_abstracted_on_one_side(spark):
    rows = [("x=<*> b", "<*> b")]
    got = scored(spark, rows, by_tokens=True)
    assert got["pa"] == 1.0 and got["fta"] == 0.0
    swapped = scored(spark, [(b, a) for a, b in rows], by_tokens=True)
    assert swapped["pa"] == 0.0 and swapped["fta"] == 1.0


def test_suite_lists_missing_datasets_and_mean(spark):
    truth = spark.createDataFrame(
        [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a"), ("z", 1, "a")], "dataset string, line_id bigint, event_template string"
    )
    parsed = truth.where("dataset <> 'z'").withColumn(
        "event_template", F.when(F.col("line_id") == 2, "wrong").otherwise(F.col("event_template"))
    )
    got = {r["dataset"]: r for r in evaluate.evaluate_suite(truth.select("dataset"), truth, parsed).collect()}
    assert set(got) == {"x", "y", "z", "Average"}
    assert got["z"]["ga"] is None and got["z"]["parsing_time"] is None
    assert got["x"]["pa"] == 0.5 and got["y"]["pa"] == 1.0 and got["Average"]["pa"] == 0.75
    assert list(got["x"].asDict()) == list(evaluate.SUMMARY_COLUMNS)


def test_correction_merges_event_ids(spark):
    rows = [(1, "E2", "Send 456"), (2, "E1", "Send 123"), (3, "E10", "root in"), (4, "E9", None), (5, "E2", "Send 456")]
    lines = spark.createDataFrame(rows, "line_id bigint, event_id string, event_template string")
    got = {r["line_id"]: r for r in correction.correct_ground_truth(lines).collect()}
    assert [got[i]["event_id"] for i in range(1, 6)] == ["E1", "E1", "E10", "E9", "E1"]
    assert [got[i]["event_template"] for i in range(1, 6)] == ["Send <*>", "Send <*>", "<*> in", None, "Send <*>"]
    assert not got[4]["corrected"]
    fixed = correction.corrected_templates(lines)
    assert [r["event_id"] for r in correction.corrected_template_table(fixed).collect()] == ["E1", "E10"]
    assert correction.correction_report(fixed).first().asDict() == {
        "templates_before": 3, "templates_after": 2, "templates_changed": 3,
    }
