"""Scoring whole suites and comparing configurations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.operators.metrics import all_metrics, contingency, pair_counts
from log_templates.plans.mine import ParseOptions
from log_templates.plans.parse import parse_suite

# The columns of a metric summary, in order.
SUMMARY_COLUMNS = (
    "dataset", "invocation_time", "parsing_time", "identified_templates",
    "ground_templates", "ga", "pa", "fga", "fta", "ed",
)


def rounded(value: Column, decimals: int = 3) -> Column:
    return F.round(value, decimals)


def evaluate(
    truth: DataFrame,
    parsed: DataFrame,
    by: str | None = "dataset",
    wanted: DataFrame | None = None,
    id_col: str = "line_id",
    by_tokens: bool = False,
) -> DataFrame:
    """All scores of a parse against ground truth, per dataset."""
    keys = [by] if by else []
    return all_metrics(contingency(truth, parsed, keys, id_col), keys, wanted, by_tokens)


def summarize(
    datasets: DataFrame,
    metrics: DataFrame,
    run_times: DataFrame | None = None,
    average_label: str = "Average",
) -> DataFrame:
    """One row per dataset at three decimals, nulls where it has no parse, and their mean."""
    scored = datasets.select("dataset").distinct().join(metrics, "dataset", "left")
    if run_times is None:
        scored = scored.withColumns({"invocation_time": F.lit(0.0), "parsing_time": F.lit(0.0)})
        scored = scored.withColumns(
            {c: F.when(F.col("ga").isNotNull(), F.col(c)) for c in ("invocation_time", "parsing_time")}
        )
    else:
        times = run_times.select("dataset", "invocation_time", "parsing_time")
        scored = scored.join(times, "dataset", "left")
    rows = scored.select(
        "dataset",
        rounded(F.col("invocation_time")).alias("invocation_time"),
        rounded(F.col("parsing_time")).alias("parsing_time"),
        F.col("identified").cast("double").alias("identified_templates"),
        F.col("ground_truth").cast("double").alias("ground_templates"),
        *[rounded(F.col(c)).alias(c) for c in ("ga", "pa", "fga", "fta")],
        rounded(F.col("ned")).alias("ed"),
    )
    mean = rows.agg(*[rounded(F.avg(c)).alias(c) for c in SUMMARY_COLUMNS[1:]]).select(
        F.lit(average_label).alias("dataset"), *SUMMARY_COLUMNS[1:]
    )
    return rows.unionByName(mean)


def evaluate_suite(
    datasets: DataFrame,
    truth: DataFrame,
    parsed: DataFrame,
    run_times: DataFrame | None = None,
    id_col: str = "line_id",
) -> DataFrame:
    """The metric summary of all datasets from one job over all lines.

    Datasets without any parsed line are listed with nulls.
    """
    present = parsed.select("dataset").distinct()
    known_truth = truth.join(present, "dataset", "left_semi")
    return summarize(datasets, evaluate(known_truth, parsed, "dataset", id_col=id_col), run_times)


def compare(
    lines: DataFrame, configs: Mapping[str, ParseOptions], id_col: str = "line_id"
) -> DataFrame:
    """Scores of several configurations on labelled lines.

    ``lines`` holds ``dataset, id, content, truth``; the result has one row per
    dataset and ``config``.
    """
    results = None
    for name, options in configs.items():
        parsed, _ = parse_suite(lines, options=options, id_col=id_col)
        table = pair_counts(parsed.withColumnRenamed("event_template", "parsed"), ["dataset"])
        scored = all_metrics(table, ["dataset"]).withColumn("config", F.lit(name))
        results = scored if results is None else results.unionByName(scored)
    return results
