"""Turning the text answer of a template oracle into a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.normalize import normalized
from log_templates.functions.text import PLACEHOLDER, as_column


def _without_wildcards(text: Column) -> Column:
    return F.replace(text, F.lit(PLACEHOLDER), F.lit(""))


def response_template(response: Column | str, ruleset: str = "base") -> Column:
    """The longest piece in backticks as a template, ``''`` if it has no constant."""
    flat = F.replace(as_column(response), F.lit("\n"), F.lit(""))
    quoted = F.regexp_extract(flat, r"(?s)`(.*)`", 1)
    pieces = F.filter(
        F.split(quoted, "`"),
        lambda p: F.replace(_without_wildcards(p), F.lit(" "), F.lit("")) != "",
    )
    longest = F.aggregate(
        pieces,
        F.lit(""),
        lambda best, piece: F.when(F.length(piece) > F.length(best), piece).otherwise(best),
    )
    template = normalized(F.regexp_replace(longest, r"(?s)\{\{.*?\}\}", PLACEHOLDER), ruleset)
    bare = F.replace(_without_wildcards(template), F.lit(" "), F.lit(""))
    return F.when(bare == "", "").otherwise(template)


def response_to_template(
    df: DataFrame, response_col: str = "response", ruleset: str = "base"
) -> DataFrame:
    """Add ``event_template``, read from a column of answers."""
    return df.withColumn("event_template", response_template(response_col, ruleset))


def responses_to_templates(
    df: DataFrame, id_col: str, response_col: str = "response", ruleset: str = "base"
) -> DataFrame:
    """Distinct templates of an answer with one template per line, in order.

    Gives ``id_col, pos, event_template``; ``pos`` is the line of the first occurrence.
    """
    lines = df.select(
        id_col,
        F.posexplode(F.split(F.regexp_replace(response_col, r"^\n+|\n+\z", ""), "\n")).alias(
            "pos", "line"
        ),
    )
    template = normalized(F.regexp_replace("line", r"(?s)\{\{.*?\}\}", PLACEHOLDER), ruleset)
    bare = F.trim(_without_wildcards(F.col("event_template")))
    return (
        lines.select(id_col, "pos", template.alias("event_template"))
        .withColumn("event_template", F.when(bare == "", "").otherwise(F.col("event_template")))
        .groupBy(id_col, "event_template")
        .agg(F.min("pos").alias("pos"))
        .select(id_col, "pos", "event_template")
    )
