"""From raw documents to token ids: rules, exact and near duplicates, source mix, encoding.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` writes each stage's rows to the
shared folder and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, free_name, table
from log_templates.llm.exact_dedup import keep_first
from log_templates.llm.minhash import minhash_components, text_key
from log_templates.llm.mixing import temperature_mix
from log_templates.llm.pieces import encode_pieces
from log_templates.llm.quality_rules import quality_rules
from log_templates.llm.queries import PIECE_MODEL, model_bytes


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose posterior probability of being good is high enough.

    Null and empty texts have no words, fail the base rules and go; a posterior of exactly one half
    goes as well; repeated rows are judged alike; texts count whole; columns stay as they are.
    """
    verdict = free_name(docs, "_quality")
    return quality_rules(docs, Scratch(spark, "quality"), out=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest id.

    Null and empty texts are equal to each other; of whole repeated rows one stays; columns stay.
    """
    return keep_first(docs, Scratch(spark, "exact"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8): the smallest id's.

    Null and empty texts and null ids are linked with nothing and stay; of rows that repeat an id each
    is judged by its own text; texts of any length count whole; columns stay as they are.
    """
    found = minhash_components(docs, Scratch(spark, "near"))
    gone = found.where(~F.col("first")).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_text")).distinct()
    same = (docs["doc_id"] == gone["_gone"]) & (text_key("text") == gone["_text"])
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, at most twice; every document stays.

    A null source is one of its own; empty texts have no tokens and stand once; rows that tie in
    the order of a source go by id; columns stay as they are.
    """
    mixed = free_name(docs, "_mix")
    return temperature_mix(docs, Scratch(spark, "mix"), out=mixed).drop(mixed)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text in place of the text: `doc_id, lang, source, n_ids, ids`.

    Null and empty texts have no ids; each row gives one row; other columns end here.
    """
    ids = encode_pieces(docs.select("doc_id", "lang", "source", "text"), model_bytes(str(PIECE_MODEL)))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", filter_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("temperature_mix", mix_sources),
    ("pieces", encode_documents),
]

# The rules' maximisation and the transducer are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
