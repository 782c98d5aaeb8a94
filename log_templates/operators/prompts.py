"""Prompt texts per batch, and what they cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.text import PLACEHOLDER

# The instruction, the placeholder of demonstrations, the overhead per message.
INSTRUCTION = (
    "You will be provided with some log messages separated by line break. You must abstract "
    "variables with `{{placeholders}}` to extract the corresponding template. There might be no "
    "variables in the log message.\nPrint the input log's template delimited by backticks."
)
DEMO_PLACEHOLDER = "{{variable}}"
MESSAGE_OVERHEAD = 4


def build_prompts(
    batches: DataFrame,
    by: Sequence[str] = (),
    style: str = "chat",
    demonstrations: DataFrame | None = None,
    instruction: str = INSTRUCTION,
) -> DataFrame:
    """``instruction, query, prompt`` per cluster from a ``batch`` array column.

    ``chat`` joins the lines by newlines, ``completion`` puts each in backticks
    under a heading.  ``demonstrations`` holds ``cluster_id, rank, log, template``
    with the nearest pair at rank 1; it is printed last, next to the lines.
    """
    if style not in ("chat", "completion"):
        raise ValueError("style is 'chat' or 'completion'")
    plain = F.array_join("batch", "\n")
    quoted = F.concat(
        F.lit("Log message:\n"),
        F.array_join(F.transform("batch", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), "\n"),
        F.lit("\nLog template: "),
    )
    if demonstrations is None:
        prompts = batches.withColumn("query", plain if style == "chat" else quoted)
    else:
        shown = F.concat(
            F.lit("Log message: `"),
            F.col("log"),
            F.lit("`\nLog template: `"),
            F.replace("template", F.lit(PLACEHOLDER), F.lit(DEMO_PLACEHOLDER)),
            F.lit("`\n"),
        )
        texts = (
            demonstrations.groupBy(*by, "cluster_id")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("o"), shown.alias("t")))).alias("_d"))
            .select(*by, "cluster_id", F.array_join(F.transform("_d", lambda d: d["t"]), "").alias("_demos"))
        )
        query = F.when(F.col("_demos").isNotNull(), F.concat("_demos", quoted)).otherwise(
            plain if style == "chat" else quoted
        )
        prompts = batches.join(texts, [*by, "cluster_id"], "left").withColumn("query", query)
    return prompts.select(
        *by,
        "cluster_id",
        F.lit(instruction).alias("instruction"),
        "query",
        F.concat(F.lit(instruction + "\n"), F.col("query")).alias("prompt"),
    )


def word_and_mark_count(text: Column) -> Column:
    """Words plus punctuation marks, a stand-in for a model's own token count."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def prompt_cost(
    messages: DataFrame,
    by: Sequence[str] = ("dataset",),
    role_col: str = "role",
    content_col: str = "content",
    count=word_and_mark_count,
    total_label: str = "all",
) -> DataFrame:
    """Tokens, messages and tokens per message for each group, and in total.

    A message costs the tokens of its role and of its text and a fixed overhead.
    ``count`` is a column expression, so a user's own tokeniser fits in.
    """
    tokens = count(F.col(role_col)) + count(F.col(content_col)) + MESSAGE_OVERHEAD
    spent = messages.select(*by, tokens.cast("bigint").alias("_tokens"))
    first, *rest = by
    grouped = spent.groupBy(*by).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("calls"))
    total = grouped.agg(F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls")).select(
        F.lit(total_label).alias(first), *[F.lit(None).cast("string").alias(c) for c in rest], "tokens", "calls"
    )
    return grouped.unionByName(total).withColumn(
        "tokens_per_call", F.round(F.col("tokens") / F.col("calls"), 2)
    )
