"""Lines against a template table.

A template table has ``event_template, reference_log, hits``; ``template_id``
breaks ties.  A line is tried only on templates whose reference line has a
similar word count and whose rarest whole constant word is a word of the line.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.matching import (
    filled_template,
    fits,
    template_parts,
    variables_in,
)
from log_templates.functions.text import (
    PLACEHOLDER,
    bind,
    collapse_ws,
    count_flat_words,
    count_words,
)
from log_templates.operators.template_index import lookup
from log_templates.tables import fits_broadcast

# The text and the word count of templates a task may hold for the lookup.
MAX_LOOKUP_ROWS = 50_000
MAX_LOOKUP_CHARS = 16_000_000
SALTS = 16
# Spark takes a table of templates for as small as its file, whatever is exploded from it; beyond the
# bound of the lookup no such side may be sent, so its joins are told to shuffle.
SHUFFLED = "shuffle_merge"


def _first_word(template: Column) -> Column:
    """The first word of a template if it is constant and complete, else null."""
    head = F.substring_index(template, " ", 1)
    return F.when(~F.contains(head, F.lit(PLACEHOLDER)) & (head != ""), head)


def _candidates(templates: DataFrame, by: Sequence[str], length_gate: bool) -> DataFrame:
    """One row per template and word count it may serve.

    ``siblings`` are the templates with the same constants, the only ones a
    template can turn into when its empty placeholders drop.
    """
    by = list(by)
    skeleton = F.replace("event_template", F.lit(PLACEHOLDER), F.lit(""))
    marked = templates.withColumn("_skeleton", skeleton)
    siblings = marked.groupBy(*by, "_skeleton").agg(
        F.collect_set("event_template").alias("siblings")
    )
    prepared = marked.join(siblings.hint(SHUFFLED), [*by, "_skeleton"]).select(
        *by,
        F.struct(
            (-F.col("hits")).cast("bigint").alias("order"),
            F.col("template_id").cast("bigint").alias("template_id"),
            F.col("event_template").alias("template"),
            template_parts("event_template").alias("parts"),
            F.col("siblings"),
        ).alias("candidate"),
        _first_word(F.col("event_template")).alias("_head"),
        count_words("reference_log").alias("_n") if length_gate else F.lit(0).alias("_n"),
    )
    if not length_gate:
        return prepared
    around = F.sequence(F.col("_n") - 1, F.col("_n") + 1)
    return prepared.withColumn("_n", F.explode(around))


def _anchored(templates: DataFrame, by: list[str], length_gate: bool) -> DataFrame:
    """Candidates with ``_anchor``, their rarest whole constant word, or "" without one."""
    constant = F.filter(
        F.split("event_template", " "), lambda w: (w != "") & ~F.contains(w, F.lit(PLACEHOLDER))
    )
    words = templates.select(*by, "event_template", F.explode(F.array_distinct(constant)).alias("_word"))
    held = words.groupBy(*by, "_word").agg(F.count_distinct("event_template").alias("_held"))
    rarest = (
        words.join(held.hint(SHUFFLED), [*by, "_word"])
        .groupBy(*by, F.col("event_template").alias("_template"))
        .agg(F.min(F.struct("_held", "_word"))["_word"].alias("_anchor"))
    )
    prepared = _candidates(templates, by, length_gate).withColumn("_template", F.col("candidate.template"))
    return prepared.join(rarest.hint(SHUFFLED), [*by, "_template"], "left").withColumn(
        "_anchor", F.coalesce("_anchor", F.lit(""))
    ).drop("_template", "_head")


def _hit(line: Column, candidate: Column) -> Column:
    """The collapsed template if it is known, else null."""
    return bind(
        filled_template(line, candidate["parts"]),
        lambda filled: F.when(F.array_contains(candidate["siblings"], filled), filled),
    )


def _first_hit(line: Column, candidates: Column) -> Column:
    """Walk the candidates in their order and stop trying after the first hit."""
    last = F.lit(2**63 - 1)
    nothing = F.struct(
        last.alias("order"),
        F.lit(None).cast("bigint").alias("template_id"),
        F.lit(None).cast("string").alias("template"),
    )

    def attempt(found: Column, candidate: Column) -> Column:
        tried = bind(
            _hit(line, candidate),
            lambda hit: F.struct(
                F.when(hit.isNull(), last).otherwise(candidate["order"]).alias("order"),
                candidate["template_id"].alias("template_id"),
                hit.alias("template"),
            ),
        )
        return F.when(found["template"].isNotNull(), found).otherwise(tried)

    return F.aggregate(candidates, nothing, attempt)


def _match_by_lookup(
    lines: DataFrame, templates: DataFrame, by: list[str], flat: Column, length_gate: bool
) -> DataFrame:
    """Templates are sent as an index of checked size; lines stay where they are."""
    known = templates.select(
        (-F.col("hits")).cast("bigint").alias("order"),
        F.col("template_id").cast("bigint"),
        "event_template",
        F.array(*(F.col(c).cast("string") for c in by)).cast("array<string>").alias("group"),
        count_words("reference_log").alias("words") if length_gate else F.lit(None).cast("int").alias("words"),
    )
    rows = [
        (r["order"], r["template_id"], r["event_template"], tuple(r["group"]), r["words"])
        for r in known.collect()
        if r["event_template"] is not None and (r["words"] is not None or not length_gate)
    ]
    sent = lines.sparkSession.sparkContext.broadcast(rows)
    return lines.withColumn("event_template", lookup(sent, uuid.uuid4().int, flat, by))


def _match_by_key(
    lines: DataFrame, candidates: DataFrame, by: list[str], flat: Column, length_gate: bool
) -> DataFrame:
    """For a stream and a template table no task can hold: arrays of templates, joined by key."""
    sorted_list = F.sort_array(F.collect_list("candidate"))
    with_head = candidates.where(F.col("_head").isNotNull())
    by_head = with_head.groupBy(*by, "_n", "_head").agg(sorted_list.alias("_named"))
    open_head = candidates.where(F.col("_head").isNull())
    by_count = open_head.groupBy(*by, "_n").agg(sorted_list.alias("_open"))
    keyed = (
        lines.withColumn("_flat", flat)
        .withColumn("_n", count_flat_words("_flat") if length_gate else F.lit(0))
        .withColumn("_head", F.substring_index("_flat", " ", 1))
    )
    looked_up = keyed.join(by_head, [*by, "_n", "_head"], "left").join(by_count, [*by, "_n"], "left")
    best = F.least(
        _first_hit(F.col("_flat"), F.col("_named")), _first_hit(F.col("_flat"), F.col("_open"))
    )
    return looked_up.select(*lines.columns, best["template"].alias("event_template"))


def _match_by_shuffle(
    lines: DataFrame,
    templates: DataFrame,
    by: list[str],
    flat: Column,
    length_gate: bool,
    id_col: str,
) -> DataFrame:
    """For a template table no task can hold: a salted equi-join on anchors, best hit per line.

    A line meets the templates whose anchor is one of its words.  Anchors of checked size are sent to
    the lines, so that a line is not shuffled for its other words.  Lines of one key are spread
    over `SALTS` tasks, and the templates of the key are repeated for each of them.
    """
    candidates = _anchored(templates, by, length_gate)
    keyed = lines.select(
        *by,
        id_col,
        flat.alias("_flat"),
        F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("_salt"),
    ).withColumn("_n", count_flat_words("_flat") if length_gate else F.lit(0))
    anchors = F.array_distinct(F.concat(F.split("_flat", " "), F.array(F.lit(""))))
    keyed = keyed.withColumn("_anchor", F.explode(anchors))
    known = candidates.select(*by, "_n", "_anchor").distinct()
    if fits_broadcast(known, ["_anchor"]):
        keyed = keyed.join(F.broadcast(known), [*by, "_n", "_anchor"], "left_semi")
    salted = candidates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = (
        keyed.join(salted.hint(SHUFFLED), [*by, "_n", "_anchor", "_salt"])
        .select(
            *by,
            id_col,
            F.col("candidate.order").alias("_order"),
            F.col("candidate.template_id").alias("_tid"),
            _hit(F.col("_flat"), F.col("candidate")).alias("_template"),
        )
        .where(F.col("_template").isNotNull())
        .groupBy(*by, id_col)
        .agg(F.min(F.struct("_order", "_tid", "_template")).alias("_best"))
        .select(*by, id_col, F.col("_best._template").alias("event_template"))
    )
    return lines.join(hits.hint(SHUFFLED), [*by, id_col], "left")


def match_templates(
    lines: DataFrame,
    templates: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    length_gate: bool = True,
    max_lookup_rows: int = MAX_LOOKUP_ROWS,
    aggregate: bool = True,
) -> DataFrame:
    """Add ``event_template``: the first known template in (hits, id) order, or null.

    A template whose empty placeholders drop counts only if the result is itself
    in the table.  A table of checked size is sent as an index and lines
    are not shuffled at all; a larger one goes through a salted equi-join.  That join
    aggregates per line, which a stream cannot: with ``aggregate`` off, lines are
    joined with sorted arrays by key instead.
    """
    by = list(by)
    flat = collapse_ws(content_col)
    small = fits_broadcast(
        templates, ["event_template"], max_lookup_rows, MAX_LOOKUP_CHARS
    )
    if small:
        return _match_by_lookup(lines, templates, by, flat, length_gate)
    if not aggregate:
        return _match_by_key(lines, _candidates(templates, by, length_gate), by, flat, length_gate)
    return _match_by_shuffle(lines, templates, by, flat, length_gate, id_col)


def unmatched_lines(matched: DataFrame) -> DataFrame:
    """Lines no template was found for."""
    return matched.where(F.col("event_template").isNull()).drop("event_template")


def prune_clusters(
    clusters: DataFrame,
    templates: DataFrame,
    by: Sequence[str] = (),
    content_col: str = "content",
) -> DataFrame:
    """Add ``event_template`` and ``matched`` to the lines of each cluster.

    ``templates`` holds at most one template per cluster.  The two halves are
    the rows with ``matched`` true and false.
    """
    fit = F.coalesce(
        fits(collapse_ws(content_col), template_parts("event_template")), F.lit(False)
    )
    return clusters.join(
        templates.select(*by, "cluster_id", "event_template"), [*by, "cluster_id"], "left"
    ).withColumn("matched", fit)


def reuse_templates(
    clusters: DataFrame,
    templates: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
) -> DataFrame:
    """The best known template that serves some line of a cluster, one row per cluster."""
    known = templates.select(
        *by, F.col("event_template"), F.col("hits").alias("_hits"), F.col("template_id").alias("_tid")
    )
    matched = match_templates(clusters, templates, by, id_col, content_col)
    best = F.min_by("event_template", F.struct(-F.col("_hits"), F.col("_tid")))
    return (
        matched.where(F.col("event_template").isNotNull())
        .select(*by, "cluster_id", "event_template")
        .distinct()
        .join(known, [*by, "event_template"])
        .groupBy(*by, "cluster_id")
        .agg(best.alias("event_template"))
    )


def filter_templates(df: DataFrame, wanted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose template is in a list."""
    return df.join(wanted.select(*by, "event_template"), [*by, "event_template"], "left_semi")


def line_variables(lines: DataFrame, content_col: str = "content") -> DataFrame:
    """Add ``variables``, the values of a line under its own ``event_template``."""
    return lines.withColumn(
        "variables", variables_in(collapse_ws(content_col), template_parts("event_template"))
    )


def subsumption_pairs(templates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs where ``general`` covers ``special``, a placeholder taking non-blank text.

    A blank stands for a run of blanks and a placeholder takes none, so both have
    the same number of words and share a constant first word: the join keys.
    """
    quoted = F.transform(
        template_parts("event_template"),
        lambda part: F.concat(
            F.lit(r"\Q"),
            F.replace(
                F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(" "), F.lit(r"\E\s+\Q")
            ),
            F.lit(r"\E"),
        ),
    )
    pattern = F.concat(F.lit("(?U)^"), F.array_join(quoted, r"\S+?"), F.lit(r"\z"))
    flat = collapse_ws("event_template")
    base = templates.select(
        *by, "event_template", flat.alias("_flat"), count_words("event_template").alias("_words")
    ).distinct()
    general = base.select(
        *by,
        F.col("event_template").alias("general"),
        "_words",
        F.coalesce(_first_word(F.col("_flat")), F.lit("")).alias("_head"),
        pattern.alias("_pattern"),
    )
    heads = F.array_distinct(F.array(F.substring_index("_flat", " ", 1), F.lit("")))
    special = base.select(
        *by, F.col("event_template").alias("special"), "_words", F.explode(heads).alias("_head")
    )
    return (
        general.join(special, [*by, "_words", "_head"])
        .where(F.col("general") != F.col("special"))
        .where(F.rlike("special", F.col("_pattern")))
        .select(*by, "general", "special")
    )
