"""Mix sources to target weights by temperature.

The weight of a source is its share of the tokens to the power ``alpha``, normalised:
1 keeps the proportions, 0 makes all sources equal.  The exponent is found by bisection,
as the smallest one that keeps every source within a repetition limit, or as the one that
meets a target entropy.  The weights are then realised with documents: a source of budget
``b`` and ``t`` tokens gives ``floor(b / t)`` whole blocks, each a permutation of all its
documents, and one partial block, the beginning of another permutation.

Without a budget the smallest one is taken that uses every document at least once, so
nothing is dropped and small sources are repeated.

Source totals stay in Spark: a pass over them evaluates 15 exponents and so takes four
steps of the bisection.  The partial block is cut by a running sum over hash buckets of
a source, and a running sum inside the one bucket where the budget ends, so a hot source
is never ordered in one task.

Defined results.  A null source is a source of its own.  A null text has no tokens; a
source without tokens gives one whole block.  Rows that repeat an id are documents of
their own; ties of the hash are cut by id and then all together.  An empty table gives
an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.llm.common import Scratch, free_name, word_list

PASSES = 8  # of four bisection steps each
BUCKETS = 4096
HASH_RANGE = 2**32


@dataclass(frozen=True)
class Mix:
    """Source table with `weight` and `epochs`, and the exponent that was found."""

    sources: DataFrame
    alpha: float
    budget: float


def _place(seed: str, block: int | Column, doc_id: Column) -> Column:
    """A document's place in the permutation of one block: 32 bits of an MD5."""
    block = F.lit(block) if isinstance(block, int) else block
    text = F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_totals(docs: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    return docs.groupBy(F.col(source_col).alias("source")).agg(
        F.count("*").alias("n_docs"), F.sum(tokens).cast("long").alias("tokens")
    )


def _measures(totals: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights and the largest number of epochs.

    With share p the weight is p^a / Z and the epochs go as p^(a-1), scaled so that the
    source with the fewest has one.
    """
    share = F.col("share")
    cols = []
    for k, a in enumerate(alphas):
        w = F.pow(share, F.lit(a))
        cols += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(w)).alias(f"e{k}")]
        rate = F.pow(share, F.lit(a - 1.0))
        cols += [(F.max(rate) / F.min(rate)).alias(f"r{k}")]
    row = totals.where("share > 0").agg(*cols).first()
    if row["z0"] is None:
        return [(0.0, 1.0)] * len(alphas)
    return [(math.log(row[f"z{k}"]) - row[f"e{k}"] / row[f"z{k}"], row[f"r{k}"]) for k in range(len(alphas))]


def bisect_exponent(totals: DataFrame, repeat_limit: float | None, entropy: float | None) -> float:
    """The exponent in [0, 1]; both measures fall as it grows, so the smallest fit is sought."""
    if entropy is None and repeat_limit is None:
        return 1.0
    lo, hi = 0.0, 1.0

    def fits(measure: tuple[float, float]) -> bool:
        return measure[0] <= entropy if entropy is not None else measure[1] <= repeat_limit

    if fits(_measures(totals, [0.0])[0]):
        return 0.0
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / 16 for k in range(1, 16)]
        known = dict(zip(grid, _measures(totals, grid), strict=True))
        for _ in range(4):
            middle = (lo + hi) / 2
            lo, hi = (lo, middle) if fits(known[middle]) else (middle, hi)
    return hi


def mix_weights(
    totals: DataFrame, scratch: Scratch, repeat_limit: float | None = 2.0, entropy: float | None = None,
    budget: float | None = None,
) -> Mix:
    """Weights and epochs per source."""
    whole = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = scratch.save(
        totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1)))), "shares"
    )
    alpha = bisect_exponent(shares, repeat_limit, entropy)
    powered = F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(0.0)
    sums = shares.agg(F.sum(powered).alias("z"), F.max(F.when(F.col("share") > 0, F.col("tokens") / powered)).alias("b")).first()
    z = sums["z"] or 1.0
    budget = float(sums["b"] or 0.0) * z if budget is None else float(budget)
    weight = powered / F.lit(z)
    epochs = F.when(F.col("tokens") > 0, F.round(F.lit(budget) * weight / F.col("tokens"), 6)).otherwise(F.lit(1.0))
    return Mix(shares.withColumn("weight", weight).withColumn("epochs", epochs), alpha, budget)


def realise(
    docs: DataFrame, sized: DataFrame, mix: Mix, scratch: Scratch, id_col: str = "doc_id", source_col: str = "source",
    seed: str = "mix", out: str = "_mix",
) -> DataFrame:
    """Each document once per block it is in, with struct ``out``: `copy, weight, order_key`.

    ``sized`` has `doc_id, source, n_tokens` of the same documents.  Reading by `order_key`
    gives every stretch of the mix about the target weights.
    """
    few = _few(mix.sources)
    known = mix.sources.select(
        F.col("source").alias("_s"), "weight", "epochs", F.floor("epochs").cast("int").alias("whole"),
        ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"),
    )
    # where in the permutation of the partial block the budget ends
    spot = (
        sized.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_s")))
        .where("rest > 0")
        .withColumn("place", _place(seed, F.col("whole"), F.col("doc_id")))
        .withColumn("bucket", F.floor(F.col("place") / (HASH_RANGE // BUCKETS)))
        .drop("_s")
    )
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        spot.groupBy("source", "bucket", "rest")
        .agg(F.sum("n_tokens").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        .where("before < rest and before + n >= rest")
        .select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before")
    )
    edge = scratch.save(edge, "edge")
    inside = spot.join(
        F.broadcast(edge) if few else edge,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")),
    )
    order = Window.partitionBy("source").orderBy("place", "doc_id")
    cut = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    # the last place whose documents still begin before the budget is used up
    ends = cut.where("upto - n_tokens < rest").groupBy(F.col("source").alias("_e")).agg(F.max("place").alias("last"))
    plan = scratch.save(
        known.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left").select(
            F.struct("weight", "epochs", "whole", F.coalesce("last", F.lit(-1)).alias("last")).alias("_p"), "_s"
        ),
        "plan",
    )
    of, plan_col, at, rank = (free_name(docs, x) for x in ("_of", "_plan", "_at", "_rank"))
    plan = plan.select(F.col("_s").alias(of), F.col("_p").alias(plan_col))
    p = F.col(plan_col)
    dealt = docs.join(F.broadcast(plan) if few else plan, docs[source_col].eqNullSafe(plan[of]))
    dealt = dealt.withColumn(at, F.explode(F.sequence(F.lit(0), p["whole"])))
    dealt = dealt.withColumn(rank, _place(seed, F.col(at), F.col(id_col)))
    dealt = dealt.where((F.col(at) < p["whole"]) | (F.col(rank) <= p["last"]))
    key = F.round((F.col(at) + F.col(rank) / HASH_RANGE) / p["epochs"], 9)
    return dealt.withColumn(
        out,
        F.struct(F.col(at).alias("copy"), p["weight"].alias("weight"), F.least(key, F.lit(1.0)).alias("order_key")),
    ).drop(of, plan_col, at, rank)


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is proven small enough to be sent to every task."""
    return len(sources.select("source").limit(most + 1).collect()) <= most


def word_tokens(text: Column) -> Column:
    """The default measure of a document: its number of words."""
    return F.size(word_list(text)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_tokens(F.col(text_col)).alias("n_tokens")
    )


def temperature_mix(
    docs: DataFrame, scratch: Scratch, sized: DataFrame | None = None, repeat_limit: float | None = 2.0,
    entropy: float | None = None, budget: float | None = None, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", seed: str = "mix", out: str = "_mix",
) -> DataFrame:
    """All columns of ``docs`` plus ``out``, one row per use of a document.

    ``sized`` (`doc_id, source, n_tokens`) replaces the word count, for example with a tokenizer's.
    """
    if sized is None:
        sized = scratch.save(sizes(docs, id_col, source_col, text_col), "sized")
    totals = scratch.save(source_totals(sized, "source", F.col("n_tokens")), "totals")
    mix = mix_weights(totals, scratch, repeat_limit, entropy, budget)
    return realise(docs, sized, mix, scratch, id_col, source_col, seed, out)
