"""Three ways to cluster log lines, all keyed by optional ``by`` columns.

Each returns the input rows with ``cluster_id``; -1 is noise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.functions.text import (
    TOKEN_SEPARATORS,
    bind,
    clean_words,
    cluster_tokens,
    drop_stop_words,
    format_signature,
)
from log_templates.operators.dedupe import token_counts
from log_templates.operators.density import density_roots
from log_templates.operators.mean_shift import mean_shift_clusters
from log_templates.operators.vectors import packed_vectors
from log_templates.tables import Scratch, number_in_order

# Words with more than one part in so many of all occurrences are sent to the lines.
FREQUENT_WORDS = 100_000


def density_clusters(
    lines: DataFrame,
    eps: float = 0.1,
    min_samples: int = 5,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    pattern: str = TOKEN_SEPARATORS,
    remove_digits: bool = True,
    copies_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Density clustering of lines by their constant tokens.

    Lines with equal token bags collapse into one weighted vector first, known by a digest of
    the bag.  A vector is a core if at least ``min_samples`` lines lie within ``eps``; cores
    within ``eps`` share a cluster; a border vector joins the lowest cluster
    among its core neighbours.  Clusters are numbered by their first core line.
    """
    by = list(by)
    scratch = scratch or Scratch(lines.sparkSession, "density")
    copies = F.col(copies_col).cast("bigint") if copies_col else F.lit(1).cast("bigint")
    tokens = F.sort_array(cluster_tokens(content_col, pattern, remove_digits))
    key = F.unhex(F.sha2(F.to_json("_bag").cast("binary"), 256))
    packing = Scratch(lines.sparkSession, "density-packs")
    tokenized = lines.withColumn("_bag", tokens).withColumn("_key", key).withColumn("_one", copies)
    tokenized = packing.save(tokenized, "keyed", wide=True, codec="zstd")
    bags = packing.save(
        tokenized.groupBy(*by, "_key").agg(
            F.min(id_col).alias("id"), F.sum("_one").alias("copies"), F.any_value("_bag").alias("_bag")
        ),
        "bags", wide=True, codec="zstd"
    )
    packs = packed_vectors(bags, "id", "_bag", by, "copies", packing)
    packs = scratch.save(packs.join(bags.select(*by, "id", "copies"), [*by, "id"]), "packed", wide=True, codec="zstd")
    # From here on lines and bags are known by their keys; the tokens go before the pairs come.
    keyed = scratch.save(tokenized.drop("_bag", "_one"), "keyed", wide=True, codec="zstd")
    bags = scratch.save(bags.drop("_bag"), "bag-keys")
    packing.drop()
    rooted = density_roots(packs, eps, min_samples, by, scratch)
    numbered = number_in_order(
        rooted.select(*by, "root").distinct(), [F.col("root")], "cluster_id", scratch, by
    )
    labels = (
        bags.select(*by, "id", "_key")
        .join(rooted, [*by, "id"])
        .join(numbered, [*by, "root"])
        .select(*by, "_key", F.col("cluster_id").alias("_cluster"))
    )
    return keyed.join(labels, [*by, "_key"], "left").select(
        *lines.columns, F.coalesce("_cluster", F.lit(-1)).cast("bigint").alias("cluster_id")
    )


def regroup_noise(
    clusters: DataFrame,
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    pattern: str = TOKEN_SEPARATORS,
    remove_digits: bool = True,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Turn noise into clusters of equal token sequences, numbered on by first line."""
    by = list(by)
    scratch = scratch or Scratch(clusters.sparkSession, "noise")
    joined = F.array_join(cluster_tokens(content_col, pattern, remove_digits), " ")
    keyed = clusters.withColumn("_key", F.when(F.col("cluster_id") == -1, joined))
    offset = clusters.groupBy(*by).agg((F.max("cluster_id") + 1).alias("_offset"))
    groups = number_in_order(
        keyed.where(F.col("_key").isNotNull()).groupBy(*by, "_key").agg(F.min(id_col).alias("_first")),
        [F.col("_first")],
        "_rank",
        scratch,
        by,
    )
    if by:
        numbered = groups.join(offset, by)
    else:
        numbered = groups.withColumn("_offset", offset.scalar())
    new_ids = numbered.select(*by, "_key", (F.col("_rank") + F.col("_offset")).alias("_new"))
    return keyed.join(new_ids, [*by, "_key"], "left").select(
        *[c for c in clusters.columns if c != "cluster_id"],
        F.coalesce("_new", "cluster_id").alias("cluster_id"),
    )


def token_keys(
    lines: DataFrame,
    granularity: str = "coarse",
    by: Sequence[str] = (),
    content_col: str = "content",
    copies_col: str | None = None,
    top: int = 3,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Add ``token_key`` and ``signature``: what frequent-token clustering groups by.

    ``token_key`` holds the ``top`` most frequent words of the cleaned line,
    sorted; it is null for lines with at most one clean word.  Words are counted
    and ranked once per distinct cleaned line, not once per line, and a cleaned
    line is known by a digest, so its text does not travel with its words.
    """
    if granularity not in ("coarse", "fine"):
        raise ValueError("granularity is 'coarse' or 'fine'")
    by = list(by)
    scratch = scratch or Scratch(lines.sparkSession, "tokenkey")
    copies = F.col(copies_col) if copies_col else F.lit(1)
    cleaned = lines.withColumn(
        "_clean",
        bind(clean_words(content_col), lambda w: F.when(F.size(w) > 1, F.array_join(w, " "))),
    )
    key = F.unhex(F.md5(F.col("_clean").cast("binary"))).alias("_key")
    counted = cleaned.groupBy(*by, "_clean").agg(F.sum(copies).alias("_copies"))
    distinct = counted.where(F.col("_clean").isNotNull()).select(*by, key, "_clean", "_copies")
    distinct = scratch.save(distinct, "cleaned", wide=True)
    counts = token_counts(distinct, by, F.split("_clean", " "), F.col("_copies"))
    keys = _top_words(distinct, scratch.save(counts, "word-counts"), by, top, scratch)
    signature = format_signature(content_col) if granularity == "fine" else F.lit("")
    return (
        cleaned.select(*lines.columns, key, signature.alias("signature"))
        .join(keys, [*by, "_key"], "left")
        .select(*lines.columns, "token_key", "signature")
    )


def _top_words(distinct: DataFrame, counts: DataFrame, by: list[str], top: int, scratch: Scratch) -> DataFrame:
    """``_key, token_key``: the ``top`` most frequent words of every cleaned line.

    Frequent words, of which there are fewer than `FREQUENT_WORDS`, are sent to the lines.  A line with ``top``
    of them has its answer; only the other words of the other lines meet their counts by a shuffle.
    """
    total = counts.agg(F.sum("occurrence")).first()[0] or 0
    frequent = counts.where(F.col("occurrence") > total / FREQUENT_WORDS)
    words = F.array_distinct(drop_stop_words(F.split("_clean", " ")))
    word = F.struct((-F.col("occurrence")).alias("o"), "token")
    placed = distinct.repartition(*by, "_key").select(*by, "_key", F.explode_outer(words).alias("token"))
    best = (
        placed.join(F.broadcast(frequent), [*by, "token"], "left")
        .groupBy(*by, "_key")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("occurrence").isNotNull(), word))).alias("_known"),
            F.collect_list(F.when(F.col("occurrence").isNull(), F.col("token"))).alias("_others"),
        )
        .select(
            *by, "_key", F.slice("_known", 1, top).alias("_known"),
            F.when(F.size("_known") < top, F.col("_others")).alias("_others"),
        )
    )
    best = scratch.save(best, "best-words")
    others = (
        best.select(*by, "_key", F.explode("_others").alias("token"))
        .join(counts, [*by, "token"])
        .groupBy(*by, "_key")
        .agg(F.sort_array(F.collect_list(word)).alias("_rare"))
        .select(*by, "_key", F.slice("_rare", 1, top).alias("_rare"))
    )
    every = F.sort_array(F.concat("_known", F.coalesce("_rare", F.array().cast("array<struct<o:bigint,token:string>>"))))
    return best.select(*by, "_key", "_known").join(others, [*by, "_key"], "left").select(
        *by, "_key", F.sort_array(F.transform(F.slice(every, 1, top), lambda t: t["token"])).alias("token_key")
    )


def token_key_clusters(
    lines: DataFrame,
    granularity: str = "coarse",
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    copies_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Clusters of lines with the same most frequent words, and the same marks if fine.

    Ids follow the first line of the word key and, inside it, of the marks.
    """
    by = list(by)
    scratch = scratch or Scratch(lines.sparkSession, "tokenkey")
    keyed = scratch.save(
        token_keys(lines, granularity, by, content_col, copies_col, scratch=scratch), "token-keys", wide=True
    )
    groups = (
        keyed.where(F.col("token_key").isNotNull())
        .groupBy(*by, "token_key", "signature")
        .agg(F.min(id_col).alias("_first"))
    )
    if granularity == "fine":
        coarse = groups.groupBy(*by, "token_key").agg(F.min("_first").alias("_key_first"))
        groups = groups.join(coarse, [*by, "token_key"])
    else:
        groups = groups.withColumn("_key_first", F.col("_first"))
    ids = number_in_order(
        groups, [F.col("_key_first"), F.col("_first")], "cluster_id", scratch, by
    ).select(*by, "token_key", "signature", "cluster_id")
    return (
        keyed.join(ids, [*by, "token_key", "signature"], "left")
        .select(*lines.columns, F.coalesce("cluster_id", F.lit(-1)).cast("bigint").alias("cluster_id"))
    )


def token_key_cluster_counts(
    lines: DataFrame, by: Sequence[str] = (), content_col: str = "content"
) -> DataFrame:
    """Numbers of coarse and of fine clusters."""
    keyed = token_keys(lines, "fine", by, content_col).where(F.col("token_key").isNotNull())
    return keyed.groupBy(*by).agg(
        F.countDistinct("token_key").alias("coarse_clusters"),
        F.countDistinct("token_key", "signature").alias("fine_clusters"),
    )


def top_tokens(
    lines: DataFrame,
    k: int = 3,
    by: Sequence[str] = (),
    content_col: str = "content",
) -> DataFrame:
    """Add ``top_tokens``: the most frequent words of each cleaned line, sorted."""
    return token_keys(lines, "coarse", by, content_col, top=k).withColumnRenamed(
        "token_key", "top_tokens"
    ).drop("signature")


def ranked_clusters(clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Clusters with their size, largest first by ``rank``."""
    scratch = Scratch(clusters.sparkSession, "ranks")
    sizes = clusters.groupBy(*by, "cluster_id").agg(F.count("*").alias("size"))
    ranked = number_in_order(sizes, [F.col("size").desc(), F.col("cluster_id")], "rank", scratch, by)
    return ranked.withColumn("rank", F.col("rank") + 1)


def cluster_logs(
    lines: DataFrame,
    method: str = "density",
    by: Sequence[str] = (),
    id_col: str = "line_id",
    content_col: str = "content",
    copies_col: str | None = None,
    scratch: Scratch | None = None,
    **options,
) -> DataFrame:
    """Cluster by ``density`` (noise regrouped), ``token_key`` or ``mean_shift``."""
    scratch = scratch or Scratch(lines.sparkSession, "clusters")
    shared = {"by": by, "id_col": id_col, "content_col": content_col, "scratch": scratch}
    if method == "density":
        found = density_clusters(lines, copies_col=copies_col, **shared, **options)
        return regroup_noise(scratch.save(found, "density", wide=True), **shared)
    if method == "token_key":
        return token_key_clusters(lines, copies_col=copies_col, **shared, **options)
    if method == "mean_shift":
        return mean_shift_clusters(lines, copies_col=copies_col, **shared, **options)
    raise ValueError(f"unknown clustering method {method!r}")
