"""How the word use of the sources of a language differs, in exact whole numbers.

Copies are collapsed first: a text that stands many times in a language is one row with its
number in each source, and is cut into terms once; its counts are weighted.  Pairs of
sources are then compared only where at least one of them has the term: all other terms
share one value, which is multiplied by their number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from log_templates.llm.common import Scratch, slices

MERGE_KEYS = 1_000_000  # (group, term) counts that a task holds before it sends them on
TOP_TERMS = 10
MIN_DOCS = 10

# every byte of a term stands for itself, A-Z for a-z, and all other ASCII for a blank
_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and term number of every term of the texts, and the distinct terms."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    clean = pa.Array.from_buffers(
        pa.large_utf8(), len(raw), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(_CLEAN[data])]
    )
    parts = pc.ascii_split_whitespace(clean)
    row = np.repeat(np.arange(len(raw)), np.diff(parts.offsets.to_numpy()))
    coded = parts.flatten().dictionary_encode()
    term, names = coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(names, "").as_py()
    if blank >= 0:
        row, term = row[term != blank], term[term != blank]
    return row, term, names


def _counted(part: pa.RecordBatch) -> tuple[pa.Table, int]:
    """Weighted counts and documents of each (lang, source, term) of a batch of collapsed texts."""
    row, term, names = _terms(part.column("text"))
    width = max(len(names), 1)
    pair, times = np.unique(row * width + term, return_counts=True)
    row, term = pair // width, pair % width
    # each (text, term) once for every source that the text stands in
    held = part.column("held")
    spans = held.offsets.to_numpy() - held.offsets[0].as_py()
    copies = np.diff(spans)[row]
    first = np.cumsum(copies) - copies
    slot = np.arange(copies.sum()) - np.repeat(first, copies) + np.repeat(spans[row], copies)
    inner = held.flatten()
    weight = inner.field("copies").to_numpy()
    lang = pc.take(part.column("lang"), pa.array(np.repeat(np.arange(part.num_rows), np.diff(spans))))
    group = pa.StructArray.from_arrays([lang, inner.field("source")], ["lang", "source"])
    labels = pa.table({"lang": lang, "source": inner.field("source"), "at": np.arange(len(group))})
    labels = labels.group_by(["lang", "source"], use_threads=False).aggregate([("at", "list")])
    number = np.empty(len(group), np.int64)
    number[labels["at_list"].combine_chunks().flatten().to_numpy()] = np.repeat(
        np.arange(labels.num_rows), pc.list_value_length(labels["at_list"]).to_numpy()
    )
    key, place = np.unique(number[slot] * width + np.repeat(term, copies), return_inverse=True)
    count, docs = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    np.add.at(count, place, np.repeat(times, copies) * weight[slot])
    np.add.at(docs, place, weight[slot])
    at = pa.array(key // width)
    return pa.table(
        {
            "lang": labels["lang"].combine_chunks().take(at),
            "source": labels["source"].combine_chunks().take(at),
            "term": names.cast(pa.string()).take(pa.array(key % width)),
            "n": count,
            "docs": docs,
        }
    ), len(key)


def _merged(tables: list[pa.Table]) -> pa.Table:
    """One row for each key; rows of a term stand together, so that its text compresses away."""
    both = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False)
    made = both.aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])
    code = made["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    return made.take(pa.array(np.argsort(code, kind="stable")))


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for part in slices(batches):
        found, keys = _counted(part)
        waiting.append(found)
        size += keys
        if size >= MERGE_KEYS:
            yield from _merged(waiting).to_batches()
            waiting, size = [], 0
    if size:
        yield from _merged(waiting).to_batches()


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def collapse(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a language: lang, text and ``held``, its copies in each source.

    Copies are counted and dropped before the shuffle; a text that fills a third of the table
    arrives once from each task, and as one small row for each of its sources.
    """
    rows = docs.select(_name("lang").alias("lang"), _name("source").alias("source"), _name("text").alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = keyed.groupBy("lang", "digest", "source").agg(F.count("*").alias("copies"))
    held = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "copies")).alias("held"))
    texts = keyed.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    return texts.join(held, ["lang", "digest"]).select("lang", "text", "held")


def count_terms(collapsed: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, n (occurrences) and all_n (those of the language), copies weighted.

    Only terms in at least ``min_docs`` documents of the language.  Tasks send what they have summed
    to the place of the term, where one pass adds it up by source and by language.
    """
    sent = collapsed.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    placed = sent.repartition(F.col("lang"), F.col("term")).groupBy("lang", "term", "source")
    counts = placed.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    known = counts.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("all_n"), F.sum("docs").over(term).alias("all_docs")
    )
    return known.where(F.col("all_docs") >= min_docs).drop("all_docs")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)) by long division in two steps: 10^9 n may not fit.

    Exact for counts up to 9 * 10^13.
    """
    below = total + 2 * terms
    whole = lambda a: F.call_function("div", a, below)
    high = (n + 2) * F.lit(100_000)
    return 1 + whole(high) * F.lit(10_000) + whole((high % below) * F.lit(10_000))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(
    docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: distances between sources, and each source's own terms.

    ``pair`` rows hold every other source of the language, ``term`` rows the ``top`` terms that
    the source uses more than the language does.  Null texts, languages and sources count as
    empty strings; a source whose documents have no terms still has its pairs, and a language
    without kept terms has distance 0.  Ties go by the item's bytes; repeated rows count as
    often as they stand; an empty table gives no rows; other columns are not read.

    The pair rows are as many as asked for, sources times sources; nothing else grows so: a
    term meets only the sources that have it, everything else is summed by equal counts.
    """
    used = scratch.save(count_terms(collapse(docs), min_docs), "used")
    groups = docs.select(_name("lang").alias("lang"), _name("source").alias("source")).distinct()
    langs = used.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    zero = F.lit(0).cast("long")
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "total", "has"]).withColumn(
        "rest", F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    )
    groups = scratch.save(groups, "groups")

    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "rest", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    shares = scratch.save(shares, "shares")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = shares.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _gap(F.col("p"), F.col("q")).alias("value"),
    )
    own = own.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    pairs = _pair_values(groups, shares, scratch)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(own)


def _pair_values(groups: DataFrame, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """The summed gap of every two sources of a language, in both directions.

    Were no term used by either, each of the language's terms would give ``base``.  A term that
    one has replaces its ``base`` by the gap to the other's share of an absent term; a term
    that both have is corrected once more.  The first correction needs only how many terms
    of a source have which share.
    """
    left, right = (groups.select("lang", F.col("source").alias(s), F.col("rest").alias(f"rest_{s}")) for s in "ab")
    every = groups.select("lang", F.col("source").alias("a"), F.col("rest").alias("rest_a"), "terms").join(
        right, "lang"
    ).where(F.col("a") != F.col("b"))
    base = F.when(F.col("terms") > 0, _gap(F.col("rest_a"), F.col("rest_b"))).otherwise(0)
    every = every.select("lang", "a", "b", (base * F.col("terms")).alias("value"))

    alike = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("rest").alias("rest_a")).agg(
        F.count("*").alias("times")
    )
    one = alike.join(right, "lang").where(F.col("a") != F.col("b")).groupBy("lang", "a", "b").agg(
        F.sum(
            F.col("times") * (_gap(F.col("p"), F.col("rest_b")) - _gap(F.col("rest_a"), F.col("rest_b")))
        ).alias("value")
    )

    side = lambda s: shares.select(
        "lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("rest").alias(f"rest_{s}")
    )
    gap = lambda x, y: _gap(F.col(f"{x}_a"), F.col(f"{y}_b"))
    both = side("a").join(side("b"), ["lang", "term"]).where(F.col("a") < F.col("b")).groupBy("lang", "a", "b").agg(
        F.sum(gap("p", "p") - gap("p", "rest") - gap("rest", "p") + gap("rest", "rest")).alias("value")
    )
    part = scratch.save(one.unionByName(both), "parts")
    turned = part.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    summed = every.unionByName(part).unionByName(turned).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value"
    )
