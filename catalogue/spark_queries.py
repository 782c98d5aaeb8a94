"""One registered query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue import inputs
from log_templates.functions import matching, normalize, responses, similarity, text
from log_templates.operators import (
    cluster,
    correction,
    dedupe,
    infer,
    match,
    mean_shift,
    metrics,
    prompts,
    sample,
    vectors,
)
from log_templates.plans import evaluate, parse
from log_templates.plans.mine import ParseOptions
from log_templates.sources import formats, sinks
from log_templates.streaming import stream
from log_templates.tables import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Every choice of these options has an exact SQL counterpart.
PLAIN = ParseOptions(clustering="token_key", sample_method="random")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


# --- sources and text -------------------------------------------------------


@query
def extract_headers(spark, sf_dir):
    found = formats.extract_headers(inputs.raw_lines(spark, sf_dir), formats.LOG_FORMATS["Apache"])
    return found.select("line_id", "time", "level", "content")


@query
def extract_headers_multi(spark, sf_dir):
    lines = inputs.raw_lines(spark, sf_dir).withColumn(
        "system", F.when(F.col("line_id") % 2 == 0, "Apache").otherwise("Proxifier")
    )
    dashed = lines.withColumn(
        "value",
        F.when(F.col("system") == "Proxifier", F.regexp_replace("value", r"^(\[[^\]]*\]) \[(\w+)\] ", "$1 $2 - ")).otherwise(F.col("value")),
    )
    found = formats.extract_headers_multi(dashed)
    return found.select(
        "line_id", "system", F.coalesce(F.col("headers")["level"], F.col("headers")["program"]).alias("label"), "content"
    )


@query
def drop_unparsable(spark, sf_dir):
    kept = formats.drop_unparsable(inputs.raw_lines(spark, sf_dir), formats.LOG_FORMATS["Apache"])
    return kept.select("line_id", "value")


@query
def collapse_ws(spark, sf_dir):
    lines = inputs.all_lines(spark, sf_dir)
    spread = F.replace("content", F.lit("e "), F.lit(" e \t"))
    return lines.select("line_id", text.collapse_ws(spread).alias("flat"), text.count_words(spread).alias("words"))


@query
def tokenize_logs(spark, sf_dir):
    lines = inputs.all_lines(spark, sf_dir)
    return lines.select("line_id", joined(text.cluster_tokens("content")).alias("tokens"))


@query
def mask_numbers(spark, sf_dir):
    return inputs.all_lines(spark, sf_dir).select("line_id", text.mask_numbers("content").alias("masked"))


@query
def clean_line(spark, sf_dir):
    return inputs.all_lines(spark, sf_dir).select("line_id", text.clean_line("content").alias("cleaned"))


@query
def format_signature(spark, sf_dir):
    return inputs.all_lines(spark, sf_dir).select("line_id", text.format_signature("content").alias("signature"))


@query
def word_tokens(spark, sf_dir):
    return inputs.all_lines(spark, sf_dir).select("line_id", joined(text.word_tokens("content")).alias("tokens"))


@query
def stop_word_filter(spark, sf_dir):
    kept = text.drop_stop_words(text.split_words("content"))
    return inputs.all_lines(spark, sf_dir).select("line_id", joined(kept).alias("tokens"))


@query
def valid_templates(spark, sf_dir):
    heads = inputs.all_lines(spark, sf_dir).select(
        "line_id", F.regexp_replace("content", r"[0-9A-Za-z]+", "<*>").alias("event_template")
    )
    return heads.where(text.is_valid_template("event_template"))


@query
def digit_heavy_tokens(spark, sf_dir):
    tokens = inputs.all_lines(spark, sf_dir).select(F.explode(text.split_words("content")).alias("token"))
    return tokens.where(text.is_digit_heavy("token")).groupBy("token").agg(F.count("*").alias("lines"))


def _normalized(ruleset: str) -> Query:
    def build(spark, sf_dir):
        lines = inputs.all_lines(spark, sf_dir)
        holes = F.regexp_replace("content", r"[0-9]+", "<*>")
        return lines.select(
            "line_id",
            normalize.normalized("content", ruleset).alias("from_text"),
            normalize.normalized(holes, ruleset).alias("from_holes"),
        )

    return build


for _ruleset in normalize.RULESETS:
    QUERIES[f"normalize_{_ruleset}"] = _normalized(_ruleset)


# --- matching ---------------------------------------------------------------


@query
def match_templates(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    return match.match_templates(lines, inputs.known_templates(spark, sf_dir))


@query
def match_templates_shuffle(spark, sf_dir):
    """The same lines and templates as beyond the bound of the lookup."""
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    return match.match_templates(lines, inputs.known_templates(spark, sf_dir), max_lookup_rows=0)


@query
def match_many_templates(spark, sf_dir):
    """About as many templates as lines."""
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    templates = Scratch(spark, "query-many").save(inputs.many_templates(spark, sf_dir), "templates")
    return match.match_templates(lines, templates)


@query
def unmatched_lines(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    return match.unmatched_lines(match.match_templates(lines, inputs.some_templates(spark, sf_dir)))


@query
def extract_variables(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).withColumnRenamed("truth_template", "event_template")
    found = match.line_variables(lines)
    return found.select("line_id", joined(F.col("variables")).alias("variables"))


@query
def collapse_empty_variables(spark, sf_dir):
    wide = F.replace("truth_template", F.lit(" <*>"), F.lit(" <*><*>"))
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content", wide.alias("wide"))
    return lines.select(
        "line_id",
        matching.collapse_empty_variables("wide", matching.extract_variables("content", "wide")).alias("event_template"),
    )


@query
def align_empty_values(spark, sf_dir):
    wide = F.replace("truth_template", F.lit(" <*>"), F.lit(" <*><*>"))
    other = F.when(F.col("line_id") % 5 == 0, F.concat(wide, F.lit(" x"))).otherwise(wide)
    lines = inputs.event_lines(spark, sf_dir)
    return lines.select("line_id", matching.align_empty_values("content", other).alias("event_template"))


def _type_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = inputs.by_type(click=F.lit(0), view=F.lit(1), purchase=F.lit(2), signup=F.lit(3), error=F.lit(4))
    return inputs.event_lines(spark, sf_dir).withColumn("cluster_id", number.cast("bigint"))


def _mixed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by item number, so each holds all kinds of lines."""
    return inputs.event_lines(spark, sf_dir).withColumn("cluster_id", F.col("k").cast("bigint"))


@query
def prune_clusters(spark, sf_dir):
    clusters = _mixed_clusters(spark, sf_dir)
    first = clusters.groupBy("cluster_id").agg(F.min_by("truth_template", "line_id").alias("event_template"))
    pruned = match.prune_clusters(clusters.select("line_id", "content", "cluster_id"), first)
    return pruned.select("line_id", "cluster_id", "matched")


@query
def reuse_templates(spark, sf_dir):
    clusters = _mixed_clusters(spark, sf_dir).select("line_id", "content", "cluster_id")
    return match.reuse_templates(clusters, inputs.some_templates(spark, sf_dir))


@query
def filter_templates(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("line_id", F.col("truth_template").alias("event_template"))
    return match.filter_templates(lines, inputs.some_templates(spark, sf_dir))


@query
def subsumption_pairs(spark, sf_dir):
    structured = inputs.structured_lines(spark, sf_dir).select("event_template")
    truth = inputs.event_lines(spark, sf_dir).select(F.col("truth_template").alias("event_template"))
    return match.subsumption_pairs(structured.union(truth).distinct())


# --- distinct lines, counts, vectors ----------------------------------------


@query
def dedupe_lines(spark, sf_dir):
    return dedupe.dedupe_lines(inputs.document_lines(spark, sf_dir))


@query
def broadcast_back(spark, sf_dir):
    lines = inputs.document_lines(spark, sf_dir).select("line_id", "content")
    distinct = dedupe.dedupe_lines(lines).select("content", text.mask_numbers("content").alias("event_template"), "copies")
    return dedupe.broadcast_back(lines, distinct).select("line_id", "event_template", "copies")


@query
def token_counts(spark, sf_dir):
    return dedupe.token_counts(inputs.document_lines(spark, sf_dir))


@query
def vocabulary_size(spark, sf_dir):
    return dedupe.token_counts(inputs.document_lines(spark, sf_dir)).agg(F.count("*").alias("words"))


@query
def top3_tokens(spark, sf_dir):
    lines = inputs.all_lines(spark, sf_dir)
    found = cluster.top_tokens(lines)
    return found.select("line_id", joined(F.col("top_tokens")).alias("top_tokens"))


@query
def distinct_template_count(spark, sf_dir):
    lines = inputs.structured_lines(spark, sf_dir)
    return dedupe.distinct_template_count(lines)


@query
def tfidf(spark, sf_dir):
    lines = inputs.document_lines(spark, sf_dir).withColumn("tokens", text.word_tokens("content"))
    weights = vectors.tfidf(lines)
    return weights.groupBy("line_id").agg(
        F.count("*").alias("terms"),
        F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"),
    )


@query
def similar_pairs(spark, sf_dir):
    lines = inputs.all_lines(spark, sf_dir).withColumn("tokens", F.array_sort(text.cluster_tokens("content")))
    scratch = Scratch(spark, "query-pairs")
    bags = scratch.save(lines.groupBy("tokens").agg(F.min("line_id").alias("line_id")), "bags")
    weights = scratch.save(vectors.tfidf(bags), "vectors")
    pairs = vectors.similar_pairs(weights, eps=0.3)
    return pairs.select("a", "b", F.round("cos", 6).alias("cos"))


def _typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs: the largest cluster of each template, drawn round-robin."""
    thirds = _type_clusters(spark, sf_dir).withColumn(
        "cluster_id", F.col("cluster_id") * 10 + F.col("k") % 3
    )
    return sample.pick_labelled_pairs(thirds, shot=8)


@query
def labelled_pairs(spark, sf_dir):
    return _typed_pairs(spark, sf_dir)


@query
def nearest_pairs(spark, sf_dir):
    scratch = Scratch(spark, "query-nearest")
    pairs = scratch.save(_typed_pairs(spark, sf_dir), "pairs")
    found = vectors.nearest_pairs(inputs.event_lines(spark, sf_dir), pairs, k=3)
    return found.select("line_id", "rank", "pair_id", F.round("cos", 6).alias("cos"))


# --- clusters and samples ----------------------------------------------------


@query
def token_key_coarse(spark, sf_dir):
    return cluster.token_key_clusters(inputs.all_lines(spark, sf_dir)).select("line_id", "cluster_id")


@query
def token_key_fine(spark, sf_dir):
    return cluster.token_key_clusters(inputs.all_lines(spark, sf_dir), "fine").select("line_id", "cluster_id")


@query
def token_key_cluster_counts(spark, sf_dir):
    return cluster.token_key_cluster_counts(inputs.all_lines(spark, sf_dir))


@query
def density_clusters(spark, sf_dir):
    return cluster.density_clusters(inputs.all_lines(spark, sf_dir)).select("line_id", "cluster_id")


@query
def regroup_noise(spark, sf_dir):
    return cluster.cluster_logs(inputs.all_lines(spark, sf_dir)).select("line_id", "cluster_id")


@query
def constant_clusters(spark, sf_dir):
    clusters = _mixed_clusters(spark, sf_dir).withColumn("dataset", F.col("event_type"))
    return dedupe.constant_clusters(clusters, ["dataset"])


@query
def cluster_sizes(spark, sf_dir):
    return dedupe.cluster_sizes(_mixed_clusters(spark, sf_dir))


@query
def ranked_clusters(spark, sf_dir):
    return cluster.ranked_clusters(_mixed_clusters(spark, sf_dir))


@query
def sample_random(spark, sf_dir):
    return sample.sample_batches(_type_clusters(spark, sf_dir), 10, "random")


@query
def sample_diverse_k2(spark, sf_dir):
    return sample.sample_batches(_type_clusters(spark, sf_dir), 2, "diverse")


@query
def sample_diverse(spark, sf_dir):
    return sample.sample_batches(_mixed_clusters(spark, sf_dir), 10, "diverse")


@query
def sample_similar(spark, sf_dir):
    return sample.sample_batches(_type_clusters(spark, sf_dir), 10, "similar")


@query
def balanced_groups(spark, sf_dir):
    points = inputs.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return sample.balanced_groups(points, 25).select("vec_id", "group_id")


@query
def mean_shift_clusters(spark, sf_dir):
    return mean_shift.mean_shift_clusters(inputs.event_lines(spark, sf_dir)).select("line_id", "cluster_id")


# --- inference, prompts, parsing ---------------------------------------------


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.sample_batches(_type_clusters(spark, sf_dir), 10, "random")


@query
def consensus_templates(spark, sf_dir):
    found = infer.infer_templates(_batches(spark, sf_dir))
    return found.select("cluster_id", "event_template", "first_line")


@query
def build_prompts(spark, sf_dir):
    gathered = infer.gather_batches(_batches(spark, sf_dir))
    plain = prompts.build_prompts(gathered).select("cluster_id", F.col("query").alias("chat"))
    quoted = prompts.build_prompts(gathered, style="completion").select("cluster_id", F.col("query").alias("completion"))
    return plain.join(quoted, "cluster_id")


@query
def build_prompts_with_pairs(spark, sf_dir):
    scratch = Scratch(spark, "query-demos")
    gathered = scratch.save(infer.gather_batches(_batches(spark, sf_dir)), "batches")
    pairs = scratch.save(_typed_pairs(spark, sf_dir), "pairs")
    firsts = gathered.select("cluster_id", F.col("batch")[0].alias("content"))
    shown = vectors.nearest_pairs(firsts, pairs, 2, id_col="cluster_id")
    return prompts.build_prompts(gathered, demonstrations=shown).select("cluster_id", "query")


@query
def response_to_template(spark, sf_dir):
    return responses.response_to_template(inputs.answers(spark, sf_dir)).select("line_id", "event_template")


@query
def responses_to_templates(spark, sf_dir):
    asked = inputs.answers(spark, sf_dir).select(
        (F.col("line_id") % 100).alias("batch_id"), "line_id", F.replace("response", F.lit("`"), F.lit("")).alias("line")
    )
    batches = asked.groupBy("batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "line"))), lambda x: x["line"]), "\n").alias("response")
    )
    return responses.responses_to_templates(batches, "batch_id")


@query
def prompt_cost(spark, sf_dir):
    talks = inputs.table(spark, sf_dir, "conversations")
    return prompts.prompt_cost(talks.withColumn("dataset", F.col("role")), content_col="text")


@query
def parse_logs(spark, sf_dir):
    parsed, _ = parse.parse_logs(inputs.event_lines(spark, sf_dir).select("line_id", "content"), options=PLAIN)
    return parsed.select("line_id", "event_template")


@query
def parse_logs_default(spark, sf_dir):
    parsed, _ = parse.parse_logs(inputs.event_lines(spark, sf_dir).select("line_id", "content"))
    return parsed.select("line_id", "event_template")


@query
def parse_logs_chunks(spark, sf_dir):
    """Chunks of a thousand lines, mined side by side and merged."""
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    parsed, _ = parse.parse_logs(lines, options=replace(PLAIN, chunk_size=1_000, lead=False))
    return parsed.select("line_id", "event_template")


@query
def template_hits(spark, sf_dir):
    """The template table that a parse in chunks returns, with the lines each template took."""
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    _, templates = parse.parse_logs(lines, options=replace(PLAIN, chunk_size=2_000))
    return templates.select("event_template", "hits")


@query
def parse_with_templates(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("line_id", "content")
    parsed, _ = parse.parse_logs(lines, inputs.some_templates(spark, sf_dir), PLAIN)
    return parsed.select("line_id", "event_template")


@query
def template_summary(spark, sf_dir):
    parsed, _ = parse.parse_logs(inputs.event_lines(spark, sf_dir).select("line_id", "content"), options=PLAIN)
    return dedupe.template_summary(parsed)


@query
def parse_documents(spark, sf_dir):
    parsed, _ = parse.parse_logs(
        inputs.document_lines(spark, sf_dir).select("line_id", "content"),
        options=ParseOptions(clustering="token_key", sample_method="random"),
    )
    return parsed.select("line_id", "event_template")


@query
def parse_suite(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("dataset", "line_id", "content")
    parsed, _ = parse.parse_suite(lines, options=PLAIN)
    return parsed.groupBy("dataset", "event_template").agg(F.count("*").alias("occurrence"))


@query
def skip_parsed(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select("dataset", "line_id", "content")
    first = lines.agg(F.min("dataset").alias("dataset"))
    parsed, _ = parse.parse_suite(lines, done=first, options=PLAIN)
    return parsed.groupBy("dataset").agg(F.count("*").alias("parsed_lines"))


@query
def compare(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir).select(
        F.col("event_type").alias("dataset"), "line_id", "content", F.col("truth_template").alias("truth")
    )
    configs = {
        f"batch-{size}": ParseOptions(clustering="token_key", sample_method="random", batch_size=size)
        for size in (5, 10)
    }
    return evaluate.compare(lines, configs).select("config", "dataset", "ga", "pa", "fta")


# --- scores -------------------------------------------------------------------


def _pairs_table(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    return metrics.pair_counts(inputs.labelled_lines(spark, sf_dir), by)


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.round(c, 6).alias(c) for c in names])


@query
def contingency(spark, sf_dir):
    lines = inputs.labelled_lines(spark, sf_dir)
    truth = lines.select("line_id", F.col("truth").alias("event_template"))
    parsed = lines.select("line_id", F.col("parsed").alias("event_template")).where(F.col("line_id") % 3 != 0)
    return metrics.contingency(truth, parsed)


@query
def grouping_accuracy(spark, sf_dir):
    return _six(metrics.grouping_accuracy(_pairs_table(spark, sf_dir)), "ga", "pga", "rga", "fga")


@query
def parsing_accuracy(spark, sf_dir):
    return _six(metrics.parsing_accuracy(_pairs_table(spark, sf_dir)), "pa")


@query
def token_accuracy(spark, sf_dir):
    return _six(metrics.token_accuracy(_pairs_table(spark, sf_dir)), "token_pa")


@query
def edit_distance(spark, sf_dir):
    return _six(metrics.edit_distance(_pairs_table(spark, sf_dir)), "ed", "ned")


@query
def similarity_accuracy(spark, sf_dir):
    return _six(metrics.similarity_accuracy(_pairs_table(spark, sf_dir)), "sa")


@query
def similarity_tokens(spark, sf_dir):
    lines = inputs.all_lines(spark, sf_dir)
    holes = F.regexp_replace("content", r"[0-9]+", "<*>")
    return lines.select("line_id", joined(similarity.similarity_tokens(holes)).alias("tokens"))


@query
def template_accuracy(spark, sf_dir):
    return _six(metrics.template_accuracy(_pairs_table(spark, sf_dir)), "pta", "rta", "fta")


@query
def template_accuracy_by_tokens(spark, sf_dir):
    return _six(metrics.template_accuracy(_pairs_table(spark, sf_dir), by_tokens=True), "pta", "rta", "fta")


@query
def metrics_filtered(spark, sf_dir):
    wanted = (
        inputs.event_lines(spark, sf_dir)
        .where(F.col("event_type").isin("click", "view", "signup"))
        .select(F.col("truth_template").alias("event_template"))
        .distinct()
    )
    table = _pairs_table(spark, sf_dir)
    found = metrics.all_metrics(table, wanted=wanted)
    return _six(found, "ga", "pga", "rga", "fga", "pa", "pta", "rta", "fta").drop("ed", "ned", "sa")


@query
def metrics_suite(spark, sf_dir):
    table = _pairs_table(spark, sf_dir, ("dataset",))
    datasets = table.select("dataset").distinct().unionByName(
        table.agg(F.concat(F.max("dataset"), F.lit(" later")).alias("dataset"))
    )
    found = evaluate.summarize(datasets, metrics.all_metrics(table, ["dataset"]))
    return found.drop("invocation_time", "parsing_time")


@query
def run_metrics(spark, sf_dir):
    runs = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"),
        F.round("value", 3).alias("invocation_time"),
        F.col("user_id").cast("double").alias("parsing_time"),
        F.struct("ts", "event_id").alias("run"),
    )
    return sinks.latest_per_dataset(runs, F.col("run")).drop("run")


# --- ground truth ---------------------------------------------------------------


@query
def correct_ground_truth(spark, sf_dir):
    fixed = correction.correct_ground_truth(inputs.structured_lines(spark, sf_dir))
    return fixed.select("line_id", "event_id", "event_template", "corrected")


@query
def corrected_templates(spark, sf_dir):
    fixed = correction.corrected_templates(inputs.structured_lines(spark, sf_dir))
    return correction.corrected_template_table(fixed)


@query
def correction_report(spark, sf_dir):
    return correction.correction_report(correction.corrected_templates(inputs.structured_lines(spark, sf_dir)))


@query
def templates_by_length(spark, sf_dir):
    templates = inputs.structured_lines(spark, sf_dir).select("event_template").distinct()
    return dedupe.templates_by_length(templates)


@query
def natural_order(spark, sf_dir):
    templates = inputs.structured_lines(spark, sf_dir).select("event_id", "event_template").distinct()
    return dedupe.natural_order(templates)


# --- streams ----------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """The event table replayed in four micro-batches, each of as many files as the table's scan keeps cores busy."""
    events = inputs.table(spark, sf_dir, "events")
    path = f"{scratch.path}/replay"
    each = min(spark.sparkContext.defaultParallelism, events.rdd.getNumPartitions())
    events.repartitionByRange(4 * each, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", each).parquet(path)


@query
def stream_match(spark, sf_dir):
    scratch = Scratch(spark, "query-stream-match")
    templates = scratch.save(inputs.known_templates(spark, sf_dir), "templates")
    lines = inputs.render_events(_event_stream(spark, sf_dir, scratch)).select("line_id", "content")
    matched = stream.stream_match(lines, templates)
    out = f"{scratch.path}/out"
    (
        matched.writeStream.option("checkpointLocation", f"{scratch.path}/state")
        .trigger(availableNow=True)
        .format("parquet")
        .start(out)
        .awaitTermination()
    )
    return spark.read.parquet(out).select("line_id", "content", "event_template")


def _parsed_stream(spark: SparkSession, sf_dir: str, scratch: Scratch, by: tuple[str, ...] = ()) -> tuple[str, str]:
    """Parse the replayed events; the folders of the lines and of the template log."""
    lines = inputs.render_events(_event_stream(spark, sf_dir, scratch)).select(*by, "line_id", "content")
    out, known = f"{scratch.path}/out", f"{scratch.path}/known"
    (
        stream.stream_parse(lines, known, out, f"{scratch.path}/state", PLAIN, by)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return out, known


@query
def stream_parse(spark, sf_dir):
    out, _ = _parsed_stream(spark, sf_dir, Scratch(spark, "query-stream-parse"))
    return stream.read_parsed_stream(spark, out).select("line_id", "event_template")


@query
def stream_hits(spark, sf_dir):
    """The template table that a stream keeps for each type of event."""
    _, known = _parsed_stream(spark, sf_dir, Scratch(spark, "query-stream-hits"), ("event_type",))
    return stream.read_stream_templates(spark, known, by=["event_type"]).select("event_type", "event_template", "hits")
