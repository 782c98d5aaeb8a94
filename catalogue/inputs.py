"""Log tables derived from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from log_templates.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def by_type(**values: Column | str) -> Column:
    """A value per event type."""
    chosen = None
    for name, value in values.items():
        value = F.lit(value) if isinstance(value, str) else value
        hit = F.col("event_type") == name
        chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
    return chosen


TRUTH = {
    "click": "click handler: user <*> opened item <*> in <*> ms",
    "view": "Received view of page <*> size <*> from user=<*>",
    "purchase": "purchase order <*> completed: amount <*>, user <*>",
    "signup": "session opened for user <*> by (uid=<*>)",
    "error": "[client <*>] request failed: code <*>",
}


def render_events(events: DataFrame) -> DataFrame:
    """``line_id, event_type, dataset, stamp, k, content, truth_template`` of an event table."""
    text = lambda c: c.cast("string")
    user, item = text(F.col("user_id")), F.get_json_object("props", "$.k")
    amount = text(F.round(F.col("value") * 100).cast("bigint"))
    content = by_type(
        click=F.concat(F.lit("click handler: user "), user, F.lit(" opened item "), item, F.lit(" in "), amount, F.lit(" ms")),
        view=F.concat(F.lit("Received view of page /item/"), item, F.lit(" size "), amount, F.lit(" from user="), user),
        purchase=F.concat(F.lit("purchase order "), text(F.col("event_id")), F.lit(" completed: amount "), amount, F.lit(", user "), user),
        signup=F.concat(F.lit("session opened for user "), user, F.lit(" by (uid="), item, F.lit(")")),
        error=F.concat(F.lit("[client 10.0."), text(F.col("user_id") % 250), F.lit("."), item, F.lit("] request failed: code "), amount),
    )
    return events.select(
        F.col("event_id").alias("line_id"),
        "event_type",
        F.date_format("ts", "yyyy-MM-dd").alias("dataset"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        item.cast("int").alias("k"),
        content.alias("content"),
        by_type(**TRUTH).alias("truth_template"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered lines of all events."""
    return render_events(table(spark, sf_dir, "events"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, lang, content`` of all lines of all documents."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
        .where(F.trim("content") != "")
        .select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line_id"), "lang", "content")
    )


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, content`` of documents and events; events have negative ids."""
    events = event_lines(spark, sf_dir)
    return document_lines(spark, sf_dir).select("line_id", "content").unionByName(
        events.select((-1 - F.col("line_id")).alias("line_id"), "content")
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, value``: event lines with a header, one in fifty without."""
    header = F.concat(F.lit("["), F.col("stamp"), F.lit("] ["), F.col("event_type"), F.lit("] "))
    bare = F.col("line_id") % 50 == 0
    return event_lines(spark, sf_dir).select(
        "line_id", F.when(bare, F.col("content")).otherwise(F.concat(header, "content")).alias("value")
    )


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with ``truth`` (some unknown) and an imperfect ``parsed``."""
    truth = F.col("truth_template")
    parsed = by_type(
        view=F.when(F.col("line_id") % 2 == 0, F.replace(truth, F.lit("page <*>"), F.lit("page /item/<*>"))).otherwise(truth),
        signup=F.replace(truth, F.lit("(uid=<*>)"), F.lit("<*>")),
        error=F.when(F.col("line_id") % 10 == 0, F.lit(TRUTH["click"])).otherwise(truth),
    )
    return event_lines(spark, sf_dir).select(
        "line_id",
        "dataset",
        F.when(F.col("line_id") % 97 != 0, truth).alias("truth"),
        F.coalesce(parsed, truth).alias("parsed"),
    )


def known_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template table: the truth of each type, and a form with an extra placeholder.

    The extra one is always empty, so its lines turn into the plain form.
    """
    types = event_lines(spark, sf_dir).groupBy("event_type").agg(
        F.min_by("content", "line_id").alias("reference_log"),
        F.first("truth_template").alias("event_template"),
        F.count("*").alias("hits"),
    )
    number = by_type(click=F.lit(1), view=F.lit(2), purchase=F.lit(3), signup=F.lit(4), error=F.lit(5))
    plain = types.select(number.cast("bigint").alias("template_id"), "event_template", "reference_log", "hits")
    wide = plain.select(
        (F.col("template_id") + 10).alias("template_id"),
        F.replace("event_template", F.lit(" <*>"), F.lit(" <*><*>")).alias("event_template"),
        "reference_log",
        (F.col("hits") + 1).alias("hits"),
    )
    return plain.unionByName(wide)


def many_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About one template per line: all but the last numbers stay."""
    lines = event_lines(spark, sf_dir)
    cut = lambda pattern, end: F.regexp_replace("content", pattern, end)
    template = by_type(
        click=cut(" in [^ ]+ ms$", " in <*> ms"),
        view=cut(" size [^ ]+ from", " size <*> from"),
        purchase=cut("amount .*$", "amount <*>, user <*>"),
        signup=F.col("content"),
        error=cut("code .*$", "code <*>"),
    )
    return lines.groupBy(template.alias("event_template")).agg(
        F.min("line_id").alias("template_id"), F.min_by("content", "line_id").alias("reference_log"), F.count("*").alias("hits")
    )


def some_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template table without views and signups."""
    return known_templates(spark, sf_dir).where(~(F.col("template_id") % 10).isin(2, 4))


def structured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines labelled too finely: the item number stays in the template."""
    number = by_type(click=F.lit(0), view=F.lit(100), purchase=F.lit(200), signup=F.lit(300), error=F.lit(400))
    item = F.col("k").cast("string")
    template = by_type(
        click=F.concat(F.lit("click handler: user <*> opened item "), item, F.lit(" in <*> ms")),
        view=F.concat(F.lit("Received view of page /item/"), item, F.lit(" size <*> from user=<*>")),
        purchase="purchase order <*> completed: amount <*>, user <*>",
        signup=F.concat(F.lit("session opened for user <*> by (uid="), item, F.lit(")")),
        error=F.concat(F.lit("[client <*>."), item, F.lit("] request failed: code <*>")),
    )
    finest = F.when(F.col("event_type") == "purchase", F.lit(0)).otherwise(F.col("k"))
    return event_lines(spark, sf_dir).select(
        "line_id",
        "content",
        F.concat(F.lit("E"), (number + finest).cast("string")).alias("event_id"),
        template.alias("event_template"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_id, response``: answers of a template oracle in several shapes."""
    asked = F.replace("truth_template", F.lit("<*>"), F.lit("{{value}}"))
    response = (
        F.when(F.col("line_id") % 10 == 0, asked)
        .when(
            F.col("line_id") % 10 == 1,
            F.concat(F.lit("Use `{{value}}` or\n`"), asked, F.lit("` here")),
        )
        .otherwise(F.concat(F.lit("Template: `"), asked, F.lit("`")))
    )
    return event_lines(spark, sf_dir).select("line_id", response.alias("response"))
