"""Mean shift clustering of sparse unit vectors by similarity joins.

All positions move at once.  Positions that see the same points have the same
mean and continue as one, so their number falls with every round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.functions.text import mask_numbers, word_tokens
from log_templates.operators.vectors import SLACK, tfidf
from log_templates.tables import Scratch, number_in_order


def _squares(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return vectors.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("weight")).alias("_sq"))


def _within(
    left: DataFrame, right: DataFrame, by: list[str], radius: float, rarity: DataFrame
) -> DataFrame:
    """Pairs ``a, b, dist`` (squared) of a left and a right vector within ``radius``.

    The rarest terms of ``a``, up to the point where the rest is too short to
    reach any vector in range, are its blocking keys.
    """
    sq_a = _squares(left, [*by, "a"])
    sq_b = _squares(right, [*by, "b"]).withColumnRenamed("_sq", "_sq_b")
    order = Window.partitionBy(*by, "a").orderBy("_df", "term")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    keys = (
        left.join(rarity, [*by, "term"])
        .join(sq_a, [*by, "a"])
        .withColumn(
            "_rest",
            F.col("_sq") - F.coalesce(F.sum(F.col("weight") * F.col("weight")).over(before), F.lit(0.0)),
        )
        .where(F.col("_rest") >= F.col("_sq") - radius * radius - SLACK)
        .select(*by, "a", "term")
    )
    candidates = keys.join(right.select(*by, "b", "term"), [*by, "term"]).select(*by, "a", "b").distinct()
    dots = (
        candidates.join(left, [*by, "a"])
        .join(right.withColumnRenamed("weight", "_wb"), [*by, "b", "term"])
        .groupBy(*by, "a", "b")
        .agg(F.sum(F.col("weight") * F.col("_wb")).alias("_dot"))
    )
    dist = F.col("_sq") + F.col("_sq_b") - 2 * F.col("_dot")
    return (
        dots.join(sq_a, [*by, "a"])
        .join(sq_b, [*by, "b"])
        .select(*by, "a", "b", dist.alias("dist"))
        .where(F.col("dist") <= radius * radius + SLACK)
    )


def _modes(
    vectors: DataFrame, weights: DataFrame, by: list[str], radius: float, max_iter: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Positions the points climb to: long vectors and the weight in reach of each."""
    rarity = scratch.save(vectors.groupBy(*by, "term").agg(F.count("*").alias("_df")), "rarity")
    points = vectors.withColumnRenamed("point", "b")
    load = weights.select(*by, F.col("point").alias("b"), F.col("copies").alias("_load"))
    active = vectors.withColumnRenamed("point", "a")
    modes, reaches = [], []
    for step in range(max_iter + 1):
        near = scratch.save(_within(active, points, by, radius, rarity).join(load, [*by, "b"]), "near")
        seen = near.groupBy(*by, "a").agg(
            F.sum("_load").alias("reach"),
            F.count("*").alias("_n"),
            F.bit_xor(F.xxhash64("b")).alias("_h1"),
            F.bit_xor(F.xxhash64("b", F.lit(1))).alias("_h2"),
        )
        seen = scratch.save(seen, "seen")
        view = [*by, "_n", "_h1", "_h2"]
        merged = scratch.save(
            seen.join(seen.groupBy(*view).agg(F.min("a").alias("rep")), view).select(
                *by, "a", "rep", "reach"
            ),
            "merged",
        )
        heads = merged.where(F.col("a") == F.col("rep")).select(*by, "a", "reach")
        means = scratch.save(
            near.join(heads, [*by, "a"])
            .join(points, [*by, "b"])
            .groupBy(*by, "a", "term")
            .agg((F.sum(F.col("_load") * F.col("weight")) / F.first("reach")).alias("weight")),
            "means",
        )
        goal = merged.select(*by, "a", "rep").join(
            means.withColumnRenamed("a", "rep"), [*by, "rep"]
        ).select(*by, "a", "rep", "term", (-F.col("weight")).alias("weight"))
        origin = active.join(merged.select(*by, "a", "rep"), [*by, "a"]).select(
            *by, "a", "rep", "term", "weight"
        )
        moved = (
            goal.unionByName(origin)
            .groupBy(*by, "a", "rep", "term")
            .agg(F.sum("weight").alias("_d"))
            .groupBy(*by, "a", "rep")
            .agg(F.sum(F.col("_d") * F.col("_d")).alias("_shift"))
            .groupBy(*by, F.col("rep").alias("a"))
            .agg(F.max("_shift").alias("_shift"))
        )
        limit = (1e-3 * radius) ** 2
        settled = moved.where((F.col("_shift") <= limit) | F.lit(step == max_iter)).select(*by, "a")
        settled = scratch.save(settled, "settled")
        # A position may settle under an id that an earlier one had; the step keeps them apart.
        tag = F.struct(F.lit(step).alias("step"), F.col("a").alias("id"))
        modes.append(means.join(settled, [*by, "a"], "left_semi").withColumn("a", tag))
        reaches.append(heads.join(settled, [*by, "a"], "left_semi").withColumn("a", tag))
        active = means.join(settled, [*by, "a"], "left_anti")
        if active.isEmpty():
            break
    all_modes, all_reaches = modes[0], reaches[0]
    for part, reach in zip(modes[1:], reaches[1:]):
        all_modes = all_modes.unionByName(part)
        all_reaches = all_reaches.unionByName(reach)
    return scratch.save(all_modes, "modes"), scratch.save(all_reaches, "reaches")


def _thin(
    modes: DataFrame, reaches: DataFrame, by: list[str], radius: float, scratch: Scratch
) -> DataFrame:
    """Drop every mode in range of a kept one with more reach: ``by, a``."""
    rarity = modes.groupBy(*by, "term").agg(F.count("*").alias("_df"))
    close = _within(modes, modes.withColumnRenamed("a", "b"), by, radius, rarity)
    rank = lambda name: F.struct((-F.col("reach")).alias("r"), F.col(name)).alias(f"_rank_{name}")
    ranked_a = reaches.select(*by, "a", rank("a"))
    ranked_b = reaches.withColumnRenamed("a", "b").select(*by, "b", rank("b"))
    beats = scratch.save(
        close.join(ranked_a, [*by, "a"])
        .join(ranked_b, [*by, "b"])
        .where(F.col("_rank_b.r").isNotNull())
        .where(
            (F.col("_rank_b.r") < F.col("_rank_a.r"))
            | ((F.col("_rank_b.r") == F.col("_rank_a.r")) & (F.col("b") < F.col("a")))
        )
        .select(*by, "a", "b"),
        "beats",
    )  # b ranks before a and is in its range
    open_modes = reaches.select(*by, "a")
    kept = None
    while not open_modes.isEmpty():
        rivals = beats.join(open_modes.withColumnRenamed("a", "b"), [*by, "b"], "left_semi")
        winners = scratch.save(open_modes.join(rivals, [*by, "a"], "left_anti"), "winners")
        kept = winners if kept is None else kept.unionByName(winners)
        losers = beats.join(winners.withColumnRenamed("a", "b"), [*by, "b"], "left_semi")
        open_modes = scratch.save(
            open_modes.join(winners, [*by, "a"], "left_anti").join(losers, [*by, "a"], "left_anti"), "open"
        )
    return kept


def mean_shift_clusters(
    lines: DataFrame,
    bandwidth: float = 0.5,
    max_iter: int = 300,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    copies_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Flat-kernel mean shift on the vectors of number-masked lines.

    Modes are numbered by the lines in their reach, most first; every line goes to
    its nearest mode.  The work grows with the pairs of distinct masked lines
    within ``bandwidth``, so use it on chunks, as `parse_logs` does.
    """
    if not 0 < bandwidth < 0.7:
        raise ValueError("bandwidth lies between 0 and 0.7, half the way to unrelated lines")
    by = list(by)
    scratch = scratch or Scratch(lines.sparkSession, "meanshift")
    copies = F.col(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    masked = lines.withColumn("_masked", mask_numbers(content_col))
    texts = scratch.save(
        masked.groupBy(*by, "_masked").agg(F.min(id_col).alias("point"), F.sum(copies).alias("copies")),
        "texts", wide=True
    )
    tokens = texts.withColumn("_tokens", word_tokens("_masked"))
    vectors = scratch.save(tfidf(tokens, "point", "_tokens", by, "copies"), "vectors")
    modes, reaches = _modes(vectors, texts, by, bandwidth, max_iter, scratch)
    kept = scratch.save(_thin(modes, reaches, by, bandwidth, scratch), "kept")
    centres = scratch.save(modes.join(kept, [*by, "a"], "left_semi").withColumnRenamed("a", "b"), "centres")

    rarity = vectors.groupBy(*by, "term").agg(F.count("*").alias("_df"))
    points = vectors.withColumnRenamed("point", "a")
    close = _within(points, centres, by, bandwidth, rarity)
    nearest = scratch.save(
        close.groupBy(*by, "a").agg(F.min_by("b", F.struct(F.round("dist", 9), "b")).alias("b")), "nearest"
    )
    # Points out of range of every centre are compared with all centres that share a term,
    # and with the shortest one, which is the nearest of those that share none.
    lone = points.join(nearest, [*by, "a"], "left_anti")
    norms = _squares(centres, [*by, "b"])
    shared = (
        lone.join(centres.withColumnRenamed("weight", "_wb"), [*by, "term"])
        .groupBy(*by, "a", "b")
        .agg(F.sum(F.col("weight") * F.col("_wb")).alias("_dot"))
        .join(norms, [*by, "b"])
        .select(*by, "a", "b", (F.col("_sq") - 2 * F.col("_dot")).alias("_off"))
    )
    lowest = norms.groupBy(*by).agg(F.min(F.struct("_sq", "b")).alias("_low"))
    alone = lone.select(*by, "a").distinct()
    alone = alone.join(lowest, by) if by else alone.withColumn("_low", lowest.select("_low").scalar())
    plain = alone.select(*by, "a", F.col("_low.b").alias("b"), F.col("_low._sq").alias("_off"))
    far = (
        shared.unionByName(plain)
        .groupBy(*by, "a")
        .agg(F.min_by("b", F.struct(F.round("_off", 9), "b")).alias("b"))
    )
    homes = nearest.unionByName(far).select(*by, F.col("a").alias("point"), F.col("b").alias("centre"))
    # Lines without any word have no vector and share one mode at the origin.
    located = scratch.save(texts.join(homes, [*by, "point"], "left"), "located")
    blank = located.where(F.col("centre").isNull()).groupBy(*by).agg(
        F.sum("copies").alias("reach"), F.min("point").alias("_id")
    ).select(*by, F.struct(F.lit(-1).alias("step"), F.col("_id").alias("id")).alias("centre"), "reach")
    ranked = (
        reaches.withColumnRenamed("a", "centre")
        .join(kept.withColumnRenamed("a", "centre"), [*by, "centre"], "left_semi")
        .select(*by, "centre", "reach")
        .unionByName(blank)
    )
    ids = number_in_order(
        ranked, [F.col("reach").desc(), F.col("centre")], "cluster_id", scratch, by
    ).select(*by, "centre", "cluster_id")
    origin = blank.select(*by, F.col("centre").alias("_blank"))
    if by:
        located = located.join(origin, by, "left")
    else:
        located = located.withColumn("_blank", origin.select("_blank").scalar())
    labels = (
        located.withColumn("centre", F.coalesce("centre", "_blank"))
        .join(ids, [*by, "centre"])
        .select(*by, "_masked", "cluster_id")
    )
    return masked.join(labels, [*by, "_masked"]).select(*lines.columns, "cluster_id")
