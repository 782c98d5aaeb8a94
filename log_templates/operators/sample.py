"""Small batches of lines per cluster, labelled pairs, balanced groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from log_templates.functions.text import bind, word_tokens
from log_templates.operators.vectors import dot, packed_vectors, tfidf
from log_templates.tables import Scratch, number_in_order

# Clusters up to this many distinct lines are sampled inside one task; larger ones
# by distributed rounds that give the same lines.
GROUP_ROWS = 20_000
# Balanced groups are formed inside cells of at most this many points.
CELL_ROWS = 1_000
# Scores are compared at this many decimals, ties go to the earlier line.
DECIMALS = 9


def sample_batches(
    clusters: DataFrame,
    batch_size: int = 10,
    method: str = "diverse",
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    seed: int = 0,
    group_rows: int = GROUP_ROWS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """At most ``batch_size`` distinct lines per cluster, all of them if there are fewer.

    ``diverse`` adds, line by line, the one that spans the most new volume
    (greedy determinant), ``random`` takes the lowest seeded hashes, ``similar``
    the group of the first line among balanced groups.  Gives ``by, cluster_id, pos, id, content`` with
    ``pos`` counting from 0 in line order.
    """
    keys = [*by, "cluster_id"]
    lines = clusters.groupBy(*keys, content_col).agg(F.min(id_col).alias(id_col))
    if method == "random":
        picked = _random(lines, keys, batch_size, content_col, seed)
    elif method in ("diverse", "similar"):
        scratch = scratch or Scratch(clusters.sparkSession, "sample")
        lines = scratch.save(lines, "distinct", wide=True)
        sizes = lines.groupBy(*keys).agg(F.count("*").alias("_size"))
        sized = lines.join(sizes, keys)
        small = sized.where(F.col("_size") <= batch_size).drop("_size")
        large = sized.where(F.col("_size") > batch_size)
        if method == "diverse":
            picked = small.unionByName(
                _diverse(large, keys, batch_size, id_col, content_col, group_rows, scratch)
            )
        else:
            picked = small.unionByName(
                _similar(large.drop("_size"), keys, batch_size, id_col, content_col, scratch)
            )
    else:
        raise ValueError(f"unknown sampling method {method!r}")
    order = Window.partitionBy(*keys).orderBy(id_col)
    return picked.select(
        *keys, (F.row_number().over(order) - 1).alias("pos"), id_col, content_col
    )


def _top(df: DataFrame, keys: list[str], k: int, order: Sequence[Column]) -> DataFrame:
    """The first k rows per key; each task keeps only k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _random(
    lines: DataFrame, keys: list[str], k: int, content_col: str, seed: int
) -> DataFrame:
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(content_col)))
    return _top(lines, keys, k, [draw, F.col(content_col)])


def _greedy_determinant(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int) -> list[int]:
    """Greedy volume maximisation over sparse unit rows by incremental Cholesky."""
    width = int(terms.max()) + 1 if len(terms) else 1
    left = np.zeros(n)
    left[np.unique(rows)] = 1.0
    factors = np.zeros((k, n))
    open_rows = np.ones(n, dtype=bool)
    chosen: list[int] = []
    for step in range(min(k, n)):
        score = np.where(open_rows, np.round(left, DECIMALS), -1.0)
        best = int(np.argmax(score))
        chosen.append(best)
        open_rows[best] = False
        if left[best] > 10.0**-DECIMALS:
            dense = np.zeros(width)
            mine = rows == best
            dense[terms[mine]] = weights[mine]
            shared = np.bincount(rows, weights=weights * dense[terms], minlength=n)
            factor = (shared - factors[:step].T @ factors[:step, best]) / np.sqrt(left[best])
            factors[step] = factor
            left = np.maximum(left - factor * factor, 0.0)
    return sorted(chosen)


def _diverse_small(
    lines: DataFrame, vectors: DataFrame, keys: list[str], k: int, id_col: str
) -> DataFrame:
    """Clusters of bounded size, each inside one task."""
    order = Window.partitionBy(*keys).orderBy(id_col)
    placed = lines.withColumn("_pos", F.row_number().over(order) - 1)
    terms = placed.select(*keys, id_col, "_pos").join(vectors, [*keys, id_col], "left").select(
        *keys, "_pos", "term", "weight"
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_pos"].max()) + 1
        known = pdf[pdf["term"].notna()]
        codes, _ = pd.factorize(known["term"])
        chosen = _greedy_determinant(
            known["_pos"].to_numpy(), codes, known["weight"].to_numpy(dtype=float), n, k
        )
        out = pdf[keys].iloc[[0] * len(chosen)].reset_index(drop=True)
        return out.assign(_pos=np.asarray(chosen, dtype="int32"))

    schema = placed.select(*keys, "_pos").schema
    picks = terms.groupBy(*keys).applyInPandas(pick, schema)
    return placed.join(picks, [*keys, "_pos"], "left_semi").drop("_pos")


def _diverse_large(
    lines: DataFrame, vectors: DataFrame, keys: list[str], k: int, id_col: str, scratch: Scratch
) -> DataFrame:
    """Clusters of any size: k rounds, each one pass over the vectors and one best line.

    A pass joins the vectors with the few terms of the lines picked so far, sums
    the products per line, and folds them into the volume the line still adds.
    The best line is found with partial aggregation, so no cluster is ever
    gathered in one place, and nothing line-sized is kept between rounds.  The vectors lie
    by line on the executors' disks, so the sums per line need no shuffle.
    """
    placed = lines.select(*keys, id_col).join(vectors, [*keys, id_col], "left").repartition(*keys, id_col)
    base = placed.persist(StorageLevel.DISK_ONLY)
    picks = None
    for step in range(k):
        if picks is None:
            products, known = base, None
        else:
            terms = picks.select(*keys, "step", "term", F.col("weight").alias("_pw"))
            products = base.join(terms, [*keys, "term"], "left")
            known = (
                picks.select(*keys, "step", id_col, "factors", "scale")
                .distinct()
                .groupBy(*keys)
                .agg(
                    F.sort_array(F.collect_list(F.struct("step", "factors", "scale"))).alias("_picks"),
                    F.collect_list(id_col).alias("_taken"),
                )
            )
        sums = products.groupBy(*keys, id_col).agg(
            F.max(F.when(F.col("weight") > 0, 1.0).otherwise(0.0)).alias("_one"),
            *[
                F.sum(F.when(F.col("step") == t, F.col("weight") * F.col("_pw")).otherwise(0.0)).alias(f"_s{t}")
                for t in range(step)
            ],
        )
        start = F.struct(F.array().cast("array<double>").alias("factors"), F.col("_one").alias("left"))
        if known is None:
            scored = sums.withColumn("_volume", start)
        else:
            dots = F.array(*[F.col(f"_s{t}") for t in range(step)])
            scored = (
                sums.join(known, keys)
                .where(~F.array_contains("_taken", F.col(id_col)))
                .withColumn(
                    "_volume",
                    F.aggregate(F.zip_with(dots, "_picks", _pair), start, _shrink),
                )
            )
        best = scored.groupBy(*keys).agg(
            F.min_by(
                F.struct(id_col, "_volume"), F.struct(-F.round("_volume.left", DECIMALS), F.col(id_col))
            ).alias("_best")
        )
        enough = F.col("_best._volume.left") > 10.0**-DECIMALS
        chosen = best.select(
            *keys,
            F.lit(step).alias("step"),
            F.col(f"_best.{id_col}").alias(id_col),
            F.col("_best._volume.factors").alias("factors"),
            F.when(enough, F.sqrt("_best._volume.left")).otherwise(0.0).alias("scale"),
        )
        chosen = scratch.save(base.join(chosen, [*keys, id_col]), f"volume-{step}")
        picks = chosen if picks is None else picks.unionByName(chosen)
    base.unpersist()
    return lines.join(picks.select(*keys, id_col).distinct(), [*keys, id_col], "left_semi")


def _pair(product: Column, pick: Column) -> Column:
    return F.struct(
        product.alias("product"), pick["factors"].alias("factors"), pick["scale"].alias("scale")
    )


def _shrink(state: Column, pick: Column) -> Column:
    """Take away the part of the volume that lies along one picked line."""
    known = F.aggregate(
        F.zip_with(state["factors"], pick["factors"], lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    factor = F.when(pick["scale"] > 0, (pick["product"] - known) / pick["scale"]).otherwise(0.0)
    return bind(
        factor,
        lambda f: F.struct(
            F.concat(state["factors"], F.array(f)).alias("factors"),
            F.greatest(state["left"] - f * f, F.lit(0.0)).alias("left"),
        ),
    )


def _diverse(
    sized: DataFrame,
    keys: list[str],
    k: int,
    id_col: str,
    content_col: str,
    group_rows: int,
    scratch: Scratch,
) -> DataFrame:
    lines = scratch.save(sized.withColumn("tokens", word_tokens(content_col)), "to-sample", wide=True)
    largest = lines.agg(F.max("_size")).first()[0] or 0
    small = lines.where(F.col("_size") <= group_rows)
    wanted = [*keys, content_col, id_col]
    vectors = scratch.save(tfidf(lines, id_col, "tokens", keys), "sample-vectors")
    found = _diverse_small(small.select(*wanted), vectors, keys, k, id_col)
    if largest > group_rows:
        large = lines.where(F.col("_size") > group_rows).select(*wanted)
        found = found.unionByName(_diverse_large(large, vectors, keys, k, id_col, scratch))
    return found


def _similar(
    lines: DataFrame, keys: list[str], k: int, id_col: str, content_col: str, scratch: Scratch
) -> DataFrame:
    """The group of the first line of each cluster, of balanced groups of at most ``k`` lines."""
    tokens = scratch.save(lines.withColumn("tokens", word_tokens(content_col)), "to-group", wide=True)
    packs = packed_vectors(tokens, id_col, "tokens", keys, scratch=scratch)
    items = F.transform("ranked", lambda i: F.struct(i["term"].alias("term"), i["weight"].alias("weight")))
    points = tokens.select(*keys, id_col).join(packs.select(*keys, id_col, items.alias("_items")), [*keys, id_col], "left")
    grouped = balanced_cells(points, keys, k, id_col, "_items", scratch=scratch, of_first=True)
    grouped = scratch.save(grouped, "grouped")
    first = grouped.groupBy(*keys).agg(F.min_by(F.struct("cell", "group"), id_col).alias("_f"))
    wanted = first.select(*keys, "_f.cell", "_f.group")
    picked = grouped.join(wanted, [*keys, "cell", "group"], "left_semi").select(*keys, id_col)
    return lines.join(picked, [*keys, id_col], "left_semi")


def pick_labelled_pairs(
    clusters: DataFrame,
    shot: int = 32,
    id_col: str = "line_id",
    content_col: str = "content",
    label_col: str = "truth_template",
) -> DataFrame:
    """``pair_id, log, template``: lines of the largest clusters with distinct labels.

    The largest cluster of each label takes part, largest first, up to ``shot``
    clusters; lines are drawn round-robin by hash until ``shot`` pairs are found.
    """
    sizes = clusters.groupBy("cluster_id").agg(
        F.count("*").alias("_size"), F.min_by(label_col, id_col).alias("template")
    )
    largest = (
        sizes.groupBy("template")
        .agg(F.min(F.struct((-F.col("_size")).alias("_order"), "cluster_id")).alias("_c"))
        .select("template", "_c._order", "_c.cluster_id")
        .orderBy("_order", "cluster_id")
        .limit(shot)
    )
    draw = F.md5(F.concat_ws(":", F.col(content_col), F.col(id_col).cast("string")))
    in_cluster = Window.partitionBy("cluster_id").orderBy("_draw", id_col)
    drawn = (
        clusters.join(largest, "cluster_id")
        .select("cluster_id", "_order", "template", F.col(content_col).alias("log"), id_col, draw.alias("_draw"))
        .withColumn("_round", F.row_number().over(in_cluster))
        .where(F.col("_round") <= shot)
        .orderBy("_round", "_order", "cluster_id")
        .limit(shot)
    )
    # At most `shot` rows are left here.
    rank = F.row_number().over(Window.orderBy("_round", "_order", "cluster_id"))
    return drawn.select(rank.alias("pair_id"), "log", "template")


def balanced_groups(
    df: DataFrame,
    capacity: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cell_rows: int = CELL_ROWS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``group_id``: groups of similar vectors with at most ``capacity`` members."""
    scratch = scratch or Scratch(df.sparkSession, "balanced")
    points = df.select(
        F.lit(0).alias("_all"), id_col,
        F.transform(vector_col, lambda x, i: F.struct(i.cast("string").alias("term"), x.cast("double").alias("weight"))).alias("_items"),
    )
    placed = balanced_cells(points, ["_all"], capacity, id_col, "_items", cell_rows, scratch)
    placed = scratch.save(placed.select(id_col, "cell", "group"), "placed")
    numbers = number_in_order(placed.select("cell", "group").distinct(), [F.col("cell"), F.col("group")], "group_id", scratch)
    return df.join(placed.join(numbers, ["cell", "group"]).select(id_col, "group_id"), id_col)


def balanced_cells(
    points: DataFrame, keys: Sequence[str], capacity: int, id_col: str, items_col: str, cell_rows: int = CELL_ROWS,
    scratch: Scratch | None = None, of_first: bool = False,
) -> DataFrame:
    """``keys, id, cell, group``: balanced groups of sparse vectors under each key, all keys in the same jobs.

    ``items_col`` is an array of ``(term, weight)``.  The points of a key are split in two by which of two far
    points is nearer, again and again, until a cell has at most ``cell_rows`` points; each cell is then
    grouped in one task by `balanced_kmeans`.  So no centre list grows with the table.
    With ``of_first`` only the cell of the first point of each key is followed and returned: cells do
    not touch each other, so it is the same cell, and the rounds shrink to it.
    """
    keys = list(keys)
    scratch = scratch or Scratch(points.sparkSession, "cells")
    open_ = points.withColumn("cell", F.lit("")).withColumn("_items", F.coalesce(items_col, F.array().cast(points.schema[items_col].dataType)))
    open_ = scratch.save(open_.select(*keys, "cell", id_col, F.sort_array("_items").alias("_items")), "cells")
    ready = None
    while True:
        sizes = open_.groupBy(*keys, "cell").agg(F.count("*").alias("_size"), F.min(F.struct(id_col, "_items")).alias("_one"))
        if of_first:
            first = open_.groupBy(*keys).agg(F.min_by("cell", id_col).alias("cell"))
            sizes = sizes.join(first, [*keys, "cell"], "left_semi")
        sized = open_.join(sizes, [*keys, "cell"])
        small = sized.where(F.col("_size") <= cell_rows).select(*open_.columns)
        ready = small if ready is None else ready.unionByName(small)
        large = sized.where(F.col("_size") > cell_rows)
        if large.isEmpty():
            break
        open_ = scratch.save(_halved(large, keys, id_col), "cells")

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        label = balanced_kmeans(_matrix(pdf["_items"]), capacity)
        return pdf[[*keys, "cell", id_col]].assign(group=label.astype("int32"))

    schema = T.StructType([*(ready.schema[c] for c in (*keys, "cell", id_col)), T.StructField("group", T.IntegerType())])
    return ready.groupBy(*keys, "cell").applyInPandas(group, schema)


def _halved(large: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Split each cell by its first point and the point farthest from it; evenly by hash if they are equal.

    A side that would get nearly nothing gives way to a split by hash too, so the rounds end.
    """
    cell = [*keys, "cell"]
    near_one = large.withColumn("_cos1", F.round(dot(F.col("_items"), F.col("_one._items")), DECIMALS))
    far = near_one.groupBy(*cell).agg(F.min_by(F.struct(id_col, "_items"), F.struct("_cos1", id_col)).alias("_two"))
    both = near_one.join(far, cell).withColumn("_cos2", F.round(dot(F.col("_items"), F.col("_two._items")), DECIMALS))
    sided = both.withColumn("_right", F.col("_cos2") > F.col("_cos1"))
    share = sided.groupBy(*cell).agg(F.avg(F.col("_right").cast("int")).alias("_share"))
    lopsided = (F.col("_share") < 0.05) | (F.col("_share") > 0.95)
    coin = F.pmod(F.xxhash64(id_col, "cell"), F.lit(2)) == 1
    right = F.when(lopsided, coin).otherwise(F.col("_right"))
    return sided.join(share, cell).select(
        *keys, F.concat("cell", F.when(right, "1").otherwise("0")).alias("cell"), id_col, "_items"
    )


def _matrix(items: pd.Series) -> np.ndarray:
    """Dense unit rows of arrays of (term, weight); a row without terms stays zero."""
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    terms = [i["term"] for x in items for i in x]
    codes, names = pd.factorize(np.array(terms, dtype=object))
    out = np.zeros((len(items), max(len(names), 1)))
    np.add.at(out, (rows, codes), [i["weight"] for x in items for i in x])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def balanced_kmeans(points: np.ndarray, capacity: int, rounds: int = 10) -> np.ndarray:
    """Group unit rows into ceil(n / capacity) groups of at most ``capacity`` rows.

    Centres start at evenly spaced rows and move ``rounds`` times to the mean of the rows
    nearest by cosine, ties to the first centre.  A full group keeps its most similar rows, earlier ones of
    equals; the others go, group by group and the most similar first, to the next group of their own
    ranking that has a free seat.
    """
    n = len(points)
    count = -(-n // capacity)
    centres = points[np.arange(count) * n // count]
    for _ in range(rounds):
        label = _cosines(points, centres).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, label, points)
        held = np.bincount(label, minlength=count)[:, None]
        centres = np.where(held > 0, total / np.maximum(held, 1), centres)
    cos = _cosines(points, centres)
    label = cos.argmax(axis=1)
    ranking = np.argsort(-cos, axis=1, kind="stable")
    seats = capacity - np.bincount(label, minlength=count)
    over = []
    for g in np.flatnonzero(seats < 0):
        members = np.flatnonzero(label == g)
        over += members[np.argsort(-cos[members, g], kind="stable")][capacity:].tolist()
    seats = np.maximum(seats, 0)
    for row in over:
        for g in ranking[row]:
            if seats[g] > 0:
                label[row] = g
                seats[g] -= 1
                break
    return label


def _cosines(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(centres, axis=1)
    products = points @ centres.T
    return np.round(np.divide(products, length, out=np.zeros_like(products), where=length > 0), DECIMALS)
