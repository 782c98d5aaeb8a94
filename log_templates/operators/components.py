"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from log_templates.tables import Scratch


def _hook(edges: DataFrame, by: list[str], larger_only: bool) -> DataFrame:
    """Point the neighbours of every node at the smallest node around it.

    With ``larger_only`` only larger neighbours move, otherwise only smaller ones.
    """
    if larger_only:
        both = edges.unionByName(
            edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))
        )
    else:
        both = edges.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy(*by, "a").agg(F.least(F.min("b"), F.col("a")).alias("_low"))
    joined = both.join(lowest, [*by, "a"])
    if larger_only:
        moved = joined.where(F.col("b") > F.col("a")).select(*by, F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        moved = joined.select(*by, "b", "_low").unionByName(
            joined.select(*by, F.col("a").alias("b"), "_low")
        ).select(*by, F.col("b").alias("a"), F.col("_low").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(
    edges: DataFrame, scratch: Scratch, by: Sequence[str] = (), max_rounds: int = 60
) -> DataFrame:
    """``node, component``: the smallest node each node of ``edges(a, b)`` is connected to.

    Alternating large-star and small-star steps shrink the graph to stars in a
    logarithmic number of rounds, whatever the length of a chain.  Each round is
    written to the shared folder.  Nodes without an edge are not listed.
    """
    by = list(by)
    current = scratch.save(
        edges.select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        row = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64(*by, "a", "b")).alias("h")
        ).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        current = scratch.save(_hook(_hook(current, by, True), by, False), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(*by, F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(
        *by, F.col("a").alias("node"), F.col("b").alias("component")
    ).unionByName(roots)
