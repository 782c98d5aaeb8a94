"""Matching and parsing log lines as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from log_templates.operators.match import MAX_LOOKUP_ROWS, match_templates
from log_templates.plans.mine import ParseOptions, empty_templates
from log_templates.plans.parse import parse_logs
from log_templates.tables import Scratch


def stream_match(
    stream: DataFrame,
    templates: DataFrame,
    by: Sequence[str] = (),
    length_gate: bool = True,
    max_lookup_rows: int = MAX_LOOKUP_ROWS,
) -> DataFrame:
    """Add ``event_template`` to a stream from a fixed template table.

    No state is needed: lines stay where they are, or beyond the lookup bound of
    `match_templates` are joined with the template arrays by key.
    """
    return match_templates(
        stream, templates, by, length_gate=length_gate, max_lookup_rows=max_lookup_rows, aggregate=False
    )


# After so many batches the template log is written anew as one table.
SNAPSHOT_EVERY = 10


def _numbered(spark: SparkSession, path: str, kind: str) -> dict[int, str]:
    """Folders ``kind=N`` of a path, by their number."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return {}
    names = [f.getPath().getName() for f in files.listStatus(target)]
    return {int(n.split("=", 1)[1]): f"{path}/{n}" for n in names if n.startswith(f"{kind}=")}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_stream_templates(
    spark: SparkSession, path: str, before: int | None = None, by: Sequence[str] = ()
) -> DataFrame | None:
    """The template table as of the batches below ``before``: rows and summed hits.

    Each batch writes its new templates and its hit counts under its own id, so a
    replayed batch replaces what it wrote and later reads add up to the same.  A read takes the
    latest snapshot and the batches after it, at most `SNAPSHOT_EVERY`.
    """
    by = list(by)
    low = lambda found: {n: p for n, p in found.items() if before is None or n < before}
    snapshots, batches = low(_numbered(spark, path, "snapshot")), low(_numbered(spark, path, "batch_id"))
    latest = max(snapshots, default=-1)
    taken = {n: p for n, p in batches.items() if n > latest}
    if latest >= 0:
        taken[latest] = snapshots[latest]
    if not taken:
        return None
    log = None
    for n, folder in sorted(taken.items()):
        part = spark.read.parquet(folder).withColumn("_batch", F.lit(n))
        log = part if log is None else log.unionByName(part)
    return log.groupBy(*by, "event_template").agg(
        F.min("template_id").alias("template_id"),
        F.min_by("reference_log", "_batch").alias("reference_log"),
        F.sum("hits").alias("hits"),
    ).select(*by, "template_id", "event_template", "reference_log", "hits")


def _snapshot(spark: SparkSession, path: str, batch_id: int, by: Sequence[str]) -> None:
    """Write the table as of a batch, and drop what two snapshots have made superfluous.

    The snapshot before stays, so a batch that is replayed after a failure still finds what it read.
    """
    table = read_stream_templates(spark, path, batch_id + 1, by)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshot={batch_id}")
    older = sorted(n for n in _numbered(spark, path, "snapshot") if n < batch_id)
    if older:
        for kind in ("snapshot", "batch_id"):
            for n, folder in _numbered(spark, path, kind).items():
                if n < older[-1] or (kind == "batch_id" and n == older[-1]):
                    _delete(spark, folder)


def parse_batch(
    batch: DataFrame, batch_id: int, template_path: str, parsed_path: str, options: ParseOptions,
    by: Sequence[str] = (),
) -> None:
    """Match one micro-batch, mine what is left, write lines, templates and hits.

    Output goes to ``batch_id=N`` folders in overwrite mode: a replay is idempotent.
    """
    by = list(by)
    spark = batch.sparkSession
    scratch = Scratch(spark, f"stream-{batch_id}")
    lines = scratch.save(batch, "lines")
    known = read_stream_templates(spark, template_path, batch_id, by)
    if known is not None:
        known = scratch.save(known, "known")
    parsed, templates = parse_logs(lines, known, options, by, scratch=scratch)
    parsed = scratch.save(parsed, "parsed")
    parsed.write.mode("overwrite").parquet(f"{parsed_path}/batch_id={batch_id}")
    counts = parsed.groupBy(*by, "event_template").agg(F.count("*").alias("_lines"))
    change = templates.join(counts, [*by, "event_template"], "left").select(
        *by,
        "template_id",
        "event_template",
        "reference_log",
        F.coalesce("_lines", F.lit(0)).cast("bigint").alias("hits"),
    )
    old = empty_templates(lines, by) if known is None else known
    new = change.join(old, [*by, "event_template"], "left_anti")
    change = change.where(F.col("hits") > 0).unionByName(new.where(F.col("hits") == 0))
    change.write.mode("overwrite").parquet(f"{template_path}/batch_id={batch_id}")
    if batch_id % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
        _snapshot(spark, template_path, batch_id, by)
    scratch.drop()


def stream_parse(
    stream: DataFrame,
    template_path: str,
    parsed_path: str,
    checkpoint: str,
    options: ParseOptions = ParseOptions(),
    by: Sequence[str] = (),
) -> DataStreamWriter:
    """A writer that parses ``line_id, content`` as they arrive; call ``start()`` on it.

    With ``by`` (for example ``dataset``) each system has its own templates.

    Each micro-batch is matched against the templates of all earlier batches, in
    the order of their hits so far; its misses are mined and serve later lines.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: parse_batch(batch, batch_id, template_path, parsed_path, options, by)
    )


def read_parsed_stream(spark: SparkSession, parsed_path: str) -> DataFrame:
    """All lines a stream has parsed so far."""
    return spark.read.option("basePath", parsed_path).parquet(parsed_path)
