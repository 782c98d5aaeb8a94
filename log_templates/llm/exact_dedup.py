"""Exact duplicates by content sort.

Splitters sampled by Spark cut the normalised texts into ranges, an external sort puts
equal texts next to each other, and neighbours are compared in full; of each run the
preferred row stays.  The range key is the beginning of the text, a hash of all of it
and a salt: so the sample that picks the splitters is small however long the texts are,
texts that share a long beginning still spread, and a text with very many copies is cut
into `SALTS` runs that different tasks sort.  The runs' leaders, one small row each
without text, are then merged by SHA-256.

Defined results.  Null counts as the empty text, and empty texts equal one another.  Of
equal texts the one with the most code points in the original, then the smallest id,
stays; a null id comes last.  Rows that repeat an id are rows of their own: exactly one
row of each group has `kept`.  Other columns are not returned by `exact_dedup`;
`keep_first` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.llm.common import SPACE_CHARS, Scratch, free_name

SALTS = 16
KEY_CHARS = 32


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document without its text: its run, the run's preferred row and size.

    The windows need the rows of one run together, which the range partitioning gives:
    no second exchange, one sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).alias("chars"),
        F.translate(text, SPACE_CHARS, "").alias("norm"),
    ).select(
        "*",
        F.substring("norm", 1, KEY_CHARS).alias("head"),
        F.xxhash64("norm").alias("whole"),
        F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).alias("salt"),
    )
    key = ["head", "whole", "salt"]
    run = Window.partitionBy(*key, "norm")
    ordered = run.orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"))
    return (
        rows.repartitionByRange(*key)
        .withColumn("place", F.row_number().over(ordered))
        .withColumn("first_id", F.first("doc_id").over(ordered))
        .select(
            "doc_id", "chars", "salt", "place", "first_id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, keep_id, group_size, kept, text_sha256`: one row per input row."""
    runs = scratch.save(_runs(docs, id_col, text_col), "runs")
    parts = runs.groupBy("text_sha256", "salt").agg(
        F.count("*").alias("n"),
        F.first("first_id").alias("leader"),
        F.max("chars").alias("chars"),
    )
    best = F.struct(-F.col("chars"), F.col("leader").isNull(), F.col("leader"), F.col("salt"))
    groups = parts.groupBy("text_sha256").agg(
        F.sum("n").alias("group_size"), F.min(best).alias("best"), F.collect_set("salt").alias("salts")
    )
    # a group has at most SALTS rows here, so its hot text is never one key of the join
    whole = groups.select(
        "text_sha256", "group_size", F.col("best.leader").alias("keep_id"),
        F.col("best.salt").alias("keep_salt"), F.explode("salts").alias("salt"),
    )
    return runs.join(whole, ["text_sha256", "salt"]).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        ((F.col("salt") == F.col("keep_salt")) & (F.col("place") == 1)).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    mark, run = free_name(docs, "_row"), free_name(docs, "_id")
    # a row number of its own: ids may repeat, and only one row of a group stays
    numbered = scratch.save(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    order = numbered.select(
        F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(mark)).alias(run), F.col(text_col).alias("text")
    )
    stay = exact_dedup(order, scratch, run, "text").where("kept").select(F.col("doc_id").alias(run))
    return numbered.join(stay.select(F.col(run).getField(mark).alias(mark)), mark, "left_semi").drop(mark)
