"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, remainder, table
from log_templates.llm.divergence import source_divergence
from log_templates.llm.exact_dedup import exact_dedup
from log_templates.llm.fill_middle import fill_in_middle, restored
from log_templates.llm.language import identify_languages
from log_templates.llm.lm import score_texts
from log_templates.llm.minhash import minhash_components
from log_templates.llm.mixing import sizes, temperature_mix
from log_templates.llm.packing import Limits, encode_examples, pack_examples
from log_templates.llm.pieces import decode_pieces, encode_pieces, normalised
from log_templates.llm.quality_rules import quality_rules
from log_templates.llm.rule_ensemble import classify_quality
from log_templates.llm.url_rules import filter_urls
from log_templates.llm.warc import round_trip

# fixed values: host, path and verdict of the hand-written url rules
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@cache
def model_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1,
        Scratch(spark, "op1"),
    )


def op2_attention_lm(spark: SparkSession, sf_dir: str, ranks_path: str = RANKS) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2
    return score_texts(docs, learn, model_bytes(str(ranks_path)), Scratch(spark, "op2"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number its path ends with: bad if low or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", "://[^/?#]*/[^?#]*?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$", 1)
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block")
    )
    labelled = pages.select("url", number.alias("number")).join(labels, "number").select("url", "block")
    return filter_urls(pages, labelled, Scratch(spark, "op4"), URL_RULES).select(
        "page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "_url.confidence"
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = remainder(F.col("doc_id"), 5) != 0
    found = identify_languages(table(spark, sf_dir, "documents"), learn, Scratch(spark, "op5"))
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, Scratch(spark, "op7"), keep=["doc_id"]).select(
        "doc_id", "_quality.n_words", "_quality.word_chars", "_quality.n_symbols", "_quality.n_dup_lines",
        "_quality.n_repeat_words", "_quality.base_failed", "_quality.kept", "_quality.posterior",
    )


def op8_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Counts and a digest of the ids of every text, and whether decoding gives the text back."""
    model = model_bytes(str(model_path))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decode_pieces(encode_pieces(docs, model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        (F.col("decoded") == normalised(F.col("text"))).alias("round_trip"),
    )


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op9")
    sized = scratch.save(sizes(table(spark, sf_dir, "documents")), "sized")
    mixed = temperature_mix(sized, scratch, sized)
    return mixed.select(
        "doc_id", "source", "n_tokens", "_mix.copy", F.round("_mix.weight", 9).alias("weight"), "_mix.order_key"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "op10"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str = WORD_MODEL) -> DataFrame:
    """Every id of a document bears loss; at most 256 pieces share a sequence."""
    limits = Limits(tokens=2048, segments=256, loss=2048)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = encode_examples(docs, model_bytes(str(tokenizer_path)), limits)
    return pack_examples(pieces, Scratch(spark, "op11"), limits).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset", "segment", "loss_tokens",
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha256 = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars",
        sha256(F.col("_fim.output")).alias("output_sha256"),
        sha256(restored(F.col("_fim.output"), F.col("_fim.form"))).alias("restored_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rule_ensemble, op2_attention_lm, op3_exact_dedup, op4_url_rules, op5_language, op6_minhash,
        op7_quality_rules, op8_pieces, op9_temperature_mix, op10_warc, op11_packing,
        op12_fill_middle, op13_source_divergence,
    )
}
