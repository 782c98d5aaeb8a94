"""Correcting ground truth: normalised templates, merged event ids."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.normalize import normalized


def corrected_templates(
    lines: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    user_strings: Iterable[str] = (),
) -> DataFrame:
    """``event_id, event_template, new_event_id, new_template`` per original template.

    An event id keeps the template of its last first-seen text; templates equal
    after the rules share the smallest event id in text order.
    """
    by = list(by)
    first_seen = (
        lines.where(F.col("event_template").isNotNull())
        .groupBy(*by, "event_template")
        .agg(F.min(F.struct(id_col, "event_id")).alias("_first"))
        .select(*by, "event_template", f"_first.{id_col}", "_first.event_id")
    )
    per_id = first_seen.groupBy(*by, "event_id").agg(
        F.max_by("event_template", id_col).alias("event_template")
    )
    fixed = per_id.withColumn("new_template", normalized("event_template", "oracle", user_strings))
    merged = fixed.groupBy(*by, "new_template").agg(F.min("event_id").alias("new_event_id"))
    return fixed.join(merged, [*by, "new_template"]).select(
        *by, "event_id", "event_template", "new_event_id", "new_template"
    )


def correct_ground_truth(
    lines: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    user_strings: Iterable[str] = (),
) -> DataFrame:
    """Rewrite ``event_id`` and ``event_template`` of a structured log.

    The rules run on the distinct templates only.  ``corrected`` is false for rows
    whose event id has no template; they keep what they had.
    """
    by = list(by)
    fixed = corrected_templates(lines, by, id_col, user_strings).drop("event_template")
    joined = lines.join(fixed, [*by, "event_id"], "left")
    kept = [c for c in lines.columns if c not in ("event_id", "event_template")]
    return joined.select(
        *kept,
        F.coalesce("new_event_id", "event_id").alias("event_id"),
        F.coalesce("new_template", "event_template").alias("event_template"),
        F.col("new_event_id").isNotNull().alias("corrected"),
    )


def natural_order(event_id: str) -> list[Column]:
    """Sort keys that put E2 before E10."""
    return [
        F.regexp_extract(event_id, r"^(\D*)", 1),
        F.regexp_extract(event_id, r"^\D*(\d+)", 1).try_cast("bigint"),
    ]


def corrected_template_table(fixed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The template table after correction, in natural order of the event ids."""
    return (
        fixed.select(
            *by, F.col("new_event_id").alias("event_id"), F.col("new_template").alias("event_template")
        )
        .distinct()
        .orderBy(*by, *natural_order("event_id"))
    )


def correction_report(fixed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Templates before, templates after, templates changed."""
    return fixed.groupBy(*by).agg(
        F.countDistinct("event_id").alias("templates_before"),
        F.countDistinct("new_template").alias("templates_after"),
        F.count_if(F.col("event_template") != F.col("new_template")).alias("templates_changed"),
    )
