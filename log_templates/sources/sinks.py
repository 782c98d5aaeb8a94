"""Writers for parsed logs, summaries and run metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.operators.correction import (
    correct_ground_truth,
    corrected_template_table,
    corrected_templates,
    natural_order,
)

RUN_METRICS_SCHEMA = "dataset string, invocation_time double, parsing_time double, ts timestamp"


def _write(df: DataFrame, path: str, file_format: str, mode: str) -> None:
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    else:
        writer.format(file_format).save(path)


def write_parsed(
    parsed: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """``Content, EventTemplate`` of a parsed log, written in parallel."""
    _write(
        parsed.select(F.col("content").alias("Content"), F.col("event_template").alias("EventTemplate")),
        path,
        file_format,
        mode,
    )


def write_summary(
    summary: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists"
) -> None:
    """``EventID, EventTemplate, Occurrence``, most frequent first."""
    _write(
        summary.orderBy(F.col("occurrence").desc(), F.length("event_id"), "event_id").select(
            F.col("event_id").alias("EventID"),
            F.col("event_template").alias("EventTemplate"),
            F.col("occurrence").alias("Occurrence"),
        ),
        path,
        file_format,
        mode,
    )


def write_corrected(
    lines: DataFrame,
    log_path: str,
    template_path: str,
    user_strings: Iterable[str] = (),
    file_format: str = "csv",
    mode: str = "errorifexists",
) -> None:
    """The corrected structured log, and its template table in natural order of the event ids.

    The log keeps its columns; ids and templates are those of `correct_ground_truth`.  The table counts
    the lines of each template.
    """
    fixed = corrected_templates(lines, user_strings=user_strings)
    corrected = correct_ground_truth(lines, user_strings=user_strings).drop("corrected")
    headed = {c: "".join(w.capitalize() for w in c.split("_")) for c in corrected.columns}
    _write(corrected.withColumnsRenamed(headed), log_path, file_format, mode)
    counts = corrected.groupBy("event_id").agg(F.count("*").alias("Occurrences"))
    table = corrected_template_table(fixed).join(counts, "event_id", "left")
    ordered = table.orderBy(*natural_order("event_id")).select(
        F.col("event_id").alias("EventId"), F.col("event_template").alias("EventTemplate"), "Occurrences"
    )
    _write(ordered, template_path, file_format, mode)


def write_metrics(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The metric summary as one CSV table."""
    _write(summary, path, "csv", mode)


def append_run_metrics(
    spark: SparkSession, path: str, dataset: str, invocation_time: float, parsing_time: float
) -> None:
    """Append the seconds a run took."""
    row = spark.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.lit(round(invocation_time, 3)).alias("invocation_time"),
        F.lit(round(parsing_time, 3)).alias("parsing_time"),
        F.current_timestamp().alias("ts"),
    )
    row.write.mode("append").parquet(path)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The latest run of each dataset."""
    return latest_per_dataset(spark.read.schema(RUN_METRICS_SCHEMA).parquet(path), F.col("ts"))


def latest_per_dataset(runs: DataFrame, order: Column) -> DataFrame:
    """The last row of each dataset in the given order."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(order.desc()))
    return runs.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
