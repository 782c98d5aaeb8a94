"""From a batch of lines to a template."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from log_templates.functions.matching import filled_template, template_parts
from log_templates.functions.normalize import TOKEN_ENDS, normalized
from log_templates.functions.responses import response_template
from log_templates.functions.text import PLACEHOLDER, bind, collapse_ws, is_valid_template
from log_templates.operators.prompts import build_prompts

Inferrer = Callable[[pd.DataFrame], pd.DataFrame]


def _agree(cut: Column) -> Column:
    """Tokens equal in all lines stay, others become placeholders."""
    return F.array_join(
        F.transform(
            cut[0],
            lambda token, i: F.when(
                F.forall(cut, lambda line: F.get(line, i) == token), token
            ).otherwise(PLACEHOLDER),
        ),
        "",
    )


def consensus(batch: Column) -> Column:
    """What the lines of a batch agree on, token by token; null if they differ in length."""
    cut = F.transform(
        batch,
        lambda line: F.regexp_extract_all(
            collapse_ws(line), F.lit(f"(?U)[^{TOKEN_ENDS}]+|[{TOKEN_ENDS}]"), F.lit(0)
        ),
    )
    return bind(
        cut,
        lambda tokens: F.when(
            F.forall(tokens, lambda line: F.size(line) == F.size(tokens[0])), _agree(tokens)
        ),
    )


def _settle(found: Column, batch: Column, ruleset: str, user_strings: Iterable[str]) -> Column:
    """Replace invalid templates, and let the first line that fits drop empty placeholders."""
    fallback = normalized(batch[0], ruleset, user_strings)
    usable = F.when(is_valid_template(found), found).otherwise(fallback)
    filled = bind(
        usable,
        lambda template: F.get(
            F.filter(
                F.transform(
                    batch, lambda line: filled_template(collapse_ws(line), template_parts(template))
                ),
                lambda t: t.isNotNull(),
            ),
            F.lit(0),
        ),
    )
    return F.coalesce(filled, fallback)


def gather_batches(
    batches: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
) -> DataFrame:
    """One row per cluster: ``batch``, its sampled lines in order, and the first line's id."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", id_col, content_col)))
    return (
        batches.groupBy(*by, "cluster_id")
        .agg(ordered.alias("_rows"))
        .select(
            *by,
            "cluster_id",
            F.transform("_rows", lambda r: r[content_col]).alias("batch"),
            F.col("_rows")[0][id_col].alias("first_line"),
        )
    )


def infer_templates(
    batches: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    ruleset: str = "base",
    user_strings: Iterable[str] = (),
    constant_shortcut: bool = False,
    inferrer: Inferrer | None = None,
    demonstrations: DataFrame | None = None,
) -> DataFrame:
    """One ``event_template`` per cluster from its batch of at most a few lines.

    The default is the consensus of the batch.  An ``inferrer`` gets pandas frames
    with a ``prompt`` column in the Python workers and returns them with a
    ``response`` column; it owns model access and retries.  Where the answer is
    null, invalid or fits no line of the batch, the normalised first line is
    used.  ``constant_shortcut`` keeps only the first line of a batch whose lines
    are equal up to digits.
    """
    gathered = gather_batches(batches, by, id_col, content_col)
    if constant_shortcut:
        bare = F.array_distinct(
            F.transform("batch", lambda line: F.regexp_replace(line, r"(?U)\d+", ""))
        )
        gathered = gathered.withColumn(
            "batch", F.when(F.size(bare) == 1, F.slice("batch", 1, 1)).otherwise(F.col("batch"))
        )
    if inferrer is None:
        answered = gathered.withColumn(
            "_found", normalized(consensus(F.col("batch")), ruleset, user_strings)
        )
    else:
        prompts = build_prompts(gathered, by, demonstrations=demonstrations)
        schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType())])
        names = schema.fieldNames()

        def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield inferrer(frame)[names]

        answers = prompts.mapInPandas(answer, schema).select(
            *by, "cluster_id", response_template("response", ruleset).alias("_found")
        )
        answered = gathered.join(answers, [*by, "cluster_id"], "left")
    return answered.select(
        *by,
        "cluster_id",
        _settle(F.col("_found"), F.col("batch"), ruleset, user_strings).alias("event_template"),
        F.col("batch")[0].alias("reference_log"),
        "first_line",
    )
