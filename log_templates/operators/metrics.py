"""Scores of a parse against ground truth, all from one contingency table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.functions.similarity import template_similarity, token_equal
from log_templates.tables import Scratch


def contingency(
    truth: DataFrame,
    parsed: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    template_col: str = "event_template",
) -> DataFrame:
    """``truth, parsed, lines``: how many lines have each pair of templates.

    The join on the line id is the only step whose size is the number of lines;
    missing parses count as ``''``, missing truth stays null.
    """
    left = truth.select(*by, id_col, F.col(template_col).alias("truth"))
    right = parsed.select(*by, id_col, F.col(template_col).alias("parsed"))
    joined = left.join(right, [*by, id_col], "left").withColumn(
        "parsed", F.coalesce("parsed", F.lit(""))
    )
    return pair_counts(joined, by)


def pair_counts(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The contingency table of lines that hold both labels, ``truth`` and ``parsed``."""
    return labelled.groupBy(*by, "truth", "parsed").agg(F.count("*").alias("lines"))


def _harmonic(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _marked(table: DataFrame, by: list[str], wanted: DataFrame | None) -> DataFrame:
    """Known truth only, with ``in_list`` telling whether the truth template counts."""
    known = table.where(F.col("truth").isNotNull())
    if wanted is None:
        return known.withColumn("in_list", F.lit(True))
    listed = wanted.select(
        *by, F.col("event_template").alias("truth"), F.lit(True).alias("in_list")
    ).distinct()
    return known.join(listed, [*by, "truth"], "left").withColumn(
        "in_list", F.coalesce("in_list", F.lit(False))
    )


def _list_size(wanted: DataFrame | None, by: list[str]) -> DataFrame | None:
    if wanted is None:
        return None
    return wanted.select(*by, "event_template").distinct().groupBy(*by).agg(
        F.count("*").alias("_listed")
    )


def _keyed(
    table: DataFrame, by: Sequence[str], wanted: DataFrame | None = None
) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Without groups, give all rows one common key so that partial scores can be joined."""
    if by:
        return table, list(by), wanted
    wanted = None if wanted is None else wanted.withColumn("_all", F.lit(0))
    return table.withColumn("_all", F.lit(0)), ["_all"], wanted


def grouping_accuracy(
    table: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """``ga, pga, rga, fga``: lines and templates whose group is found exactly.

    A truth group counts if all its lines have one parsed template and no other
    line has it.  ``wanted`` restricts the score to a list of truth templates.
    """
    asked = list(by)
    table, by, wanted = _keyed(table, by, wanted)
    known = _marked(table, by, wanted)
    truth = known.groupBy(*by, "truth").agg(
        F.sum("lines").alias("_size"),
        F.count("*").alias("_parts"),
        F.min("parsed").alias("parsed"),
        F.first("in_list").alias("in_list"),
    )
    parsed = known.groupBy(*by, "parsed").agg(
        F.sum("lines").alias("_parsed_size"), F.max("in_list").alias("_touched")
    )
    joined = truth.join(parsed.drop("_touched"), [*by, "parsed"])
    exact = (F.col("_parts") == 1) & (F.col("_size") == F.col("_parsed_size")) & F.col("in_list")
    found = joined.groupBy(*by).agg(
        F.sum(F.when(exact, F.col("_size")).otherwise(0)).alias("_lines_right"),
        F.count_if(exact).alias("_right"),
        F.sum(F.when(F.col("in_list"), F.col("_size")).otherwise(0)).alias("_lines"),
        F.count("*").alias("_truth"),
    )
    identified = parsed.groupBy(*by).agg(F.count_if("_touched").alias("_identified"))
    both = found.join(identified, by, "left")
    if wanted is None:
        both = both.withColumn("_listed", F.col("_truth"))
    else:
        both = both.join(_list_size(wanted, by), by, "left")
    pga, rga = _share(F.col("_right"), F.col("_identified")), _share(F.col("_right"), F.col("_listed"))
    return both.select(
        *asked,
        _share(F.col("_lines_right"), F.col("_lines")).alias("ga"),
        pga.alias("pga"),
        rga.alias("rga"),
        _harmonic(pga, rga).alias("fga"),
    )


def _line_share(
    table: DataFrame, by: list[str], wanted: DataFrame | None, right: Column, name: str
) -> DataFrame:
    """Share of lines for which ``right`` holds; unknown truth counts as wrong."""
    if wanted is not None:
        table = _marked(table, by, wanted).where("in_list")
    hits = F.sum(F.when(right, F.col("lines")).otherwise(0))
    return table.groupBy(*by).agg(_share(hits, F.sum("lines")).alias(name))


def parsing_accuracy(
    table: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """``pa``: share of lines whose parsed template equals the true one."""
    return _line_share(table, list(by), wanted, F.col("truth") == F.col("parsed"), "pa")


def token_accuracy(
    table: DataFrame, by: Sequence[str] = (), wanted: DataFrame | None = None
) -> DataFrame:
    """``token_pa``: as `parsing_accuracy`, comparing words with placeholders abstracted."""
    return _line_share(table, list(by), wanted, token_equal("truth", "parsed"), "token_pa")


def edit_distance(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ed, ned``: mean edit distance, and mean of 1 minus its share of the longer template.

    The distance is taken once per pair of templates, not once per line.
    """
    known = table.where(F.col("truth").isNotNull())
    longer = F.greatest(F.length("truth"), F.length("parsed"))
    distance = F.levenshtein("truth", "parsed")
    scored = known.select(
        *by,
        "lines",
        distance.alias("_d"),
        F.when(F.col("truth") == F.col("parsed"), 1.0).otherwise(1 - distance / longer).alias("_n"),
    )
    return scored.groupBy(*by).agg(
        _share(F.sum(F.col("_d") * F.col("lines")), F.sum("lines")).alias("ed"),
        _share(F.sum(F.col("_n") * F.col("lines")), F.sum("lines")).alias("ned"),
    )


def similarity_accuracy(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``sa``: mean token similarity of true and parsed template over the lines."""
    known = table.where(F.col("truth").isNotNull())
    scored = known.select(*by, "lines", template_similarity("truth", "parsed").alias("_s"))
    return scored.groupBy(*by).agg(
        _share(F.sum(F.col("_s") * F.col("lines")), F.sum("lines")).alias("sa")
    )


def template_accuracy(
    table: DataFrame,
    by: Sequence[str] = (),
    wanted: DataFrame | None = None,
    by_tokens: bool = False,
) -> DataFrame:
    """``identified, ground_truth, pta, rta, fta``: templates found as written.

    A parsed template is right if all its lines have one true template and both
    are the same text; with ``by_tokens`` the words of the parsed one are abstracted first.
    """
    asked = list(by)
    table, by, wanted = _keyed(table, by, wanted)
    known = _marked(table, by, wanted)
    parsed = known.groupBy(*by, "parsed").agg(
        F.count("*").alias("_parts"),
        F.min("truth").alias("truth"),
        F.max("in_list").alias("_touched"),
    )
    same = token_equal("parsed", "truth") if by_tokens else F.col("truth") == F.col("parsed")
    right = (F.col("_parts") == 1) & same & F.col("_touched")
    found = parsed.groupBy(*by).agg(
        F.count_if(right).alias("_right"), F.count_if("_touched").alias("identified")
    )
    if wanted is None:
        size = known.groupBy(*by).agg(F.countDistinct("truth").alias("_listed"))
    else:
        size = _list_size(wanted, by)
    both = found.join(size, by, "left")
    pta, rta = _share(F.col("_right"), F.col("identified")), _share(F.col("_right"), F.col("_listed"))
    return both.select(
        *asked,
        "identified",
        F.col("_listed").alias("ground_truth"),
        pta.alias("pta"),
        rta.alias("rta"),
        _harmonic(pta, rta).alias("fta"),
    )


def all_metrics(
    table: DataFrame,
    by: Sequence[str] = (),
    wanted: DataFrame | None = None,
    by_tokens: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Every score per group, side by side.

    The contingency table is written once, so the lines behind it are read once.
    """
    scratch = scratch or Scratch(table.sparkSession, "metrics")
    table, by, wanted = _keyed(table, by, wanted)
    table = scratch.save(table, "contingency")
    pa = token_accuracy if by_tokens else parsing_accuracy
    result = template_accuracy(table, by, wanted, by_tokens)
    for part in (
        grouping_accuracy(table, by, wanted),
        pa(table, by, wanted),
        edit_distance(table, by),
        similarity_accuracy(table, by),
    ):
        result = result.join(part, by, "left")
    return result.drop("_all").withColumnRenamed("token_pa", "pa")
