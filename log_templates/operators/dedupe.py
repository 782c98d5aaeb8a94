"""Distinct lines, counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from log_templates.functions.text import drop_digits, drop_stop_words, split_words
from log_templates.tables import Scratch, number_in_order


def dedupe_lines(
    lines: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
) -> DataFrame:
    """One row per distinct line: first id and number of copies.

    Copies are counted before the shuffle, so a line that fills a third of the
    table costs one row per task.
    """
    return lines.groupBy(*by, content_col).agg(
        F.min(id_col).alias(id_col), F.count("*").alias("copies")
    )


def broadcast_back(
    lines: DataFrame,
    parsed: DataFrame,
    by: Sequence[str] = (),
    content_col: str = "content",
) -> DataFrame:
    """Give every line what was found for its distinct text.

    An equi-join with one row per text on the right; adaptive execution
    broadcasts a small right side and splits a skewed left one.
    """
    return lines.join(parsed, [*by, content_col])


def cluster_sizes(clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines per cluster, with a rank by size; no global sort."""
    return clusters.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))


def constant_clusters(
    clusters: DataFrame, by: Sequence[str] = (), content_col: str = "content"
) -> DataFrame:
    """Whether the lines of a cluster are equal once digits are removed."""
    bare = drop_digits(content_col)
    return clusters.groupBy(*by, "cluster_id").agg(
        (F.min(bare) == F.max(bare)).alias("is_constant"), F.count("*").alias("size")
    )


def token_counts(
    lines: DataFrame, by: Sequence[str] = (), words=None, weight=None
) -> DataFrame:
    """How often each word occurs once stop words are dropped."""
    words = split_words("content") if words is None else words
    weight = F.lit(1) if weight is None else weight
    return (
        lines.select(*by, F.explode(drop_stop_words(words)).alias("token"), weight.alias("_w"))
        .groupBy(*by, "token")
        .agg(F.sum("_w").cast("bigint").alias("occurrence"))
    )


def template_counts(
    parsed: DataFrame, by: Sequence[str] = (), id_col: str = "line_id"
) -> DataFrame:
    """Occurrences and first line of each template."""
    return parsed.groupBy(*by, "event_template").agg(
        F.count("*").alias("occurrence"), F.min(id_col).alias("first_line")
    )


def template_summary(
    parsed: DataFrame, by: Sequence[str] = (), id_col: str = "line_id", scratch: Scratch | None = None
) -> DataFrame:
    """Templates with event ids ``E1, E2, …`` by occurrence, ties by first line."""
    scratch = scratch or Scratch(parsed.sparkSession, "summary")
    numbered = number_in_order(
        template_counts(parsed, by, id_col),
        [F.col("occurrence").desc(), F.col("first_line")],
        "_rank",
        scratch,
        by,
    )
    return numbered.select(
        *by,
        F.concat(F.lit("E"), (F.col("_rank") + 1).cast("string")).alias("event_id"),
        "event_template",
        "occurrence",
    )


def distinct_template_count(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct templates."""
    return parsed.groupBy(*by).agg(F.countDistinct("event_template").alias("templates"))


def templates_by_length(templates: DataFrame) -> DataFrame:
    """Templates with their length, longest first."""
    return templates.withColumn("length", F.length("event_template")).orderBy(
        F.col("length").desc(), "event_template"
    )


def natural_order(templates: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Event ids sorted by prefix, then by number: E2 before E10."""
    return templates.orderBy(
        F.regexp_extract(id_col, r"^(\D*)", 1),
        F.regexp_extract(id_col, r"^\D*(\d+)", 1).try_cast("bigint"),
        id_col,
    )
