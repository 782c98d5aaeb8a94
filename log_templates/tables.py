"""Tables written between steps, global numbering, and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A side is broadcast only if it has at most this many rows and characters.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_CHARS = 64_000_000
SPLIT_BYTES = 64 * 1024


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="log-templates-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Writes a step's result once and reads it back.

    This cuts the lineage, survives the loss of executors, and gives the
    following joins true sizes.  One instance owns one folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/log_templates/{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, label: str = "step", wide: bool = False, codec: str | None = None) -> DataFrame:
        """Write and read back; ``wide`` marks a table of lines that heavy work follows on.

        ``codec`` is a Parquet compression other than the session's, for steps that are mostly bytes.
        """
        self._count += 1
        path = f"{self.path}/{self._count:04d}-{label}"
        df.write.parquet(path, compression=codec)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved = spread(saved) if wide else saved
        self._paths[id(saved)] = path
        return saved

    def free(self, *saved: DataFrame) -> None:
        """Delete single steps; only after every table that reads them has been written."""
        for step in saved:
            self._delete(self._paths.pop(id(step)))

    def settle(self) -> None:
        """Let Spark delete the shuffle files of steps that are over: it does so for plans the driver has collected."""
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        """Delete what was written; only after everything read from it has been used."""
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(
    df: DataFrame,
    text_cols: Sequence[str] = (),
    max_rows: int = MAX_BROADCAST_ROWS,
    max_chars: int = MAX_BROADCAST_CHARS,
) -> bool:
    """Count a table and the length of its texts, and compare with the bounds."""
    chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in text_cols), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.sum(chars).alias("chars")).first()
    return row["n"] <= max_rows and (row["chars"] or 0) <= max_chars


def spread(df: DataFrame) -> DataFrame:
    """Split a table that comes in fewer files than its size and the cores allow.

    Text work is heavy per byte, so a split of `SPLIT_BYTES` is worth a task.  A
    table whose scan already has a task per core, as on a cluster, stays as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    useful = min(df.sparkSession.sparkContext.defaultParallelism, size // SPLIT_BYTES + 1)
    if df.rdd.getNumPartitions() >= useful:
        return df
    return df.repartition(useful)


def number_in_order(
    df: DataFrame,
    order: Sequence[Column],
    output_col: str,
    scratch: Scratch,
    by: Sequence[str] = (),
) -> DataFrame:
    """Dense numbers from 0 in the given order, per ``by`` group.

    Rows are range-sorted over all executors and numbered inside their
    partition; only one count per partition and group is summed up.  No
    window ever holds the whole table.
    """
    by = list(by)
    place = F.monotonically_increasing_id()
    ranged = scratch.save(
        df.orderBy(*by, *order).withColumn("_place", place), f"ordered-{output_col}"
    ).withColumn("_part", F.shiftright("_place", 33))
    counts = ranged.groupBy(*by, "_part").agg(
        F.count("*").alias("_rows"), F.min("_place").alias("_lowest")
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *by, "_part", "_lowest", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    return (
        ranged.join(offsets, [*by, "_part"])
        .withColumn(output_col, F.col("_place") - F.col("_lowest") + F.col("_before"))
        .drop("_place", "_part", "_lowest", "_before")
    )
