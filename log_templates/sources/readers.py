"""Readers for raw logs, structured logs and template tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from log_templates.functions.text import strip_blanks
from log_templates.sources.formats import extract_headers

# Spellings of the column names in structured files.
COLUMN_NAMES = {
    "lineid": "line_id",
    "content": "content",
    "eventid": "event_id",
    "eventtemplate": "event_template",
    "occurrence": "occurrence",
    "occurrences": "occurrence",
}


def read_raw_logs(
    spark: SparkSession, path: str | list[str], log_format: str | None = None
) -> DataFrame:
    """Raw text files, one log per line, as ``line_id`` and header fields or ``content``.

    ``line_id`` is ``(file, block, place in the block)``: unique and in file order
    without numbering all lines in one place.
    """
    text = spark.read.text(path)
    lines = text.select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
        ).alias("line_id"),
        strip_blanks("value").alias("value"),
    )
    if log_format is None:
        return lines.withColumnRenamed("value", "content")
    return extract_headers(lines, log_format)


def _read_csv(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line)
    return df.withColumnsRenamed(
        {c: COLUMN_NAMES.get(c.lower().replace("_", ""), c.lower()) for c in df.columns}
    )


def read_structured_logs(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """A structured log with ``line_id, content`` and what else the file has.

    ``EventId`` and ``EventID`` are both read.  Only missing values are null.  A log
    has one record per line, so files are split over tasks; ``multi_line`` reads
    quoted line ends at the price of one task per file.
    """
    df = _read_csv(spark, path, multi_line)
    if "line_id" in df.columns:
        return df.withColumn("line_id", F.col("line_id").cast("bigint"))
    return df.withColumn("line_id", F.monotonically_increasing_id())


def read_templates(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """A template file: ``event_id, event_template`` and ``occurrence`` if present."""
    df = _read_csv(spark, path, multi_line)
    if "occurrence" in df.columns:
        df = df.withColumn("occurrence", F.col("occurrence").cast("bigint"))
    return df
