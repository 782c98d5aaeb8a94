"""Language identification: known words first, then shorter and shorter letter sequences.

A word that is frequent in some language of the training texts is scored by its log
frequency per language.  Any other word falls back to its sequences of four letters, then
three, two and one: the first length with a known sequence decides.  A text gets the
language with the largest sum, and the posterior probability of that language as score.

The counts cover every training text.  A word is known if it makes up at least
`WORD_SHARE` of the words of its language, a sequence at least `GRAM_SHARE` of those of
its length: the same rule at every size, which bounds the tables that travel with the
tasks by 1 / share entries per language.

Defined results.  A null text and one without a letter give `und` and score 0.  A null
language is not learned from.  With nothing to learn from every text is `und`.  Of equal
sums the first language in order wins.  Ids may be null or repeat; each row gives a row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm.common import Scratch, slices

WORD_SHARE = 1e-5
GRAM_SHARE = 1e-4
LONGEST = 4
FLUSH_WORDS = 300_000  # distinct words a task counts before it emits them
CACHE_WORDS = 200_000  # words whose scores a task remembers
EDGE = " "  # stands for the start and end of a word

_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return _letters((text or "").lower())


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())],
            names=["lang", "word", "n"],
        )

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            counts[lang].update(words_of(text))
        if sum(map(len, counts.values())) > FLUSH_WORDS:
            yield flush()
    yield flush()


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies per language of the known words and sequences."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length, from 1

    def scores(self, word: str) -> np.ndarray | None:
        """Log score per language of one word; none without a letter or anything known."""
        found = self.words.get(word)
        if found is not None:
            return found
        if not word.isalpha():
            word = "".join(c for c in word if c.isalpha())
            if not word:
                return None
        edged = EDGE + word + EDGE
        for size in range(LONGEST, 0, -1):
            table = self.grams[size - 1]
            got = [table[g] for k in range(len(edged) - size + 1) if (g := edged[k : k + size]) in table]
            if got:
                return sum(got) / size
        return np.zeros(len(self.languages))


def _table(rows: DataFrame, languages: list[str], totals: dict[str, int]) -> dict[str, np.ndarray]:
    """Known entries as log frequencies.

    What a language lacks counts as half an occurrence in the largest language, so that a
    language with few texts does not gain by what it lacks.
    """
    at = {lang: k for k, lang in enumerate(languages)}
    out: dict[str, np.ndarray] = {}
    floor = np.full(len(languages), np.log(0.5 / max(1, *totals.values())))
    for r in rows.toLocalIterator():
        if r["entry"] not in out:
            out[r["entry"]] = floor.copy()
        out[r["entry"]][at[r["lang"]]] = np.log(r["n"] / totals[r["lang"]])
    return out


def fit_languages(train: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count words and sequences of all training texts and keep the frequent ones."""
    rows = train.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counted = rows.mapInArrow(_count_words, "lang string, word string, n long")
    counts = scratch.save(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], {}, [{} for _ in range(LONGEST)])
    of_lang = counts.sparkSession.createDataFrame([(k, v) for k, v in totals.items()], "lang string, total long")

    def frequent(table: DataFrame, total: DataFrame, on: list[str], share: float) -> DataFrame:
        return table.join(F.broadcast(total), on).where(F.col("n") >= F.greatest(F.lit(2.0), share * F.col("total")))

    # a word that is known in one language needs its count in all of them
    strong = frequent(counts, of_lang, ["lang"], WORD_SHARE).select("word").distinct()
    known = counts.join(strong, "word", "left_semi").withColumnRenamed("word", "entry")
    words = _table(known, languages, totals)

    edged = F.concat(F.lit(EDGE), F.col("word"), F.lit(EDGE))
    pieces = F.flatten(
        F.array(
            *[
                F.transform(
                    F.when(F.length(edged) >= size, F.sequence(F.lit(1), F.length(edged) - (size - 1))).otherwise(
                        F.array().cast("array<int>")
                    ),
                    lambda k, size=size: F.substring(edged, k, F.lit(size)),
                )
                for size in range(1, LONGEST + 1)
            ]
        )
    )
    grams = counts.select("lang", "n", F.explode(pieces).alias("entry")).groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    grams = scratch.save(grams.withColumn("size", F.length("entry")), "grams")
    gram_total = grams.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    total_of = {(r["size"], r["lang"]): r["total"] for r in gram_total.collect()}
    kept = frequent(grams, gram_total, ["lang", "size"], GRAM_SHARE)
    tables = [
        _table(kept.where(F.col("size") == size), languages, {x: total_of.get((size, x), 1) for x in languages})
        for size in range(1, LONGEST + 1)
    ]
    return LanguageModel(languages, words, tables)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, lang_pred, score`: one row per document, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    send = docs.sparkSession.sparkContext.broadcast(model)
    width = max(1, len(model.languages))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = send.value
        known = np.zeros((CACHE_WORDS + 1, width))

        class Rows(dict):
            """Row of a word in ``known``; row 0 stands for words without a letter."""

            used = 1

            def __missing__(self, word: str) -> int:
                found = made.scores(word)
                if found is None:
                    row = 0
                else:
                    row = self.used
                    known[row] = found
                    self.used = row + 1
                self[word] = row
                return row

        index = Rows()
        for part in slices(batches, 64):
            names, scores = [], []
            for text in part.column("text").to_pylist():
                words = words_of(text) if made.languages else []
                if len(index) + len(words) > CACHE_WORDS and len(words) <= CACHE_WORDS:
                    index.clear()
                    index.used = 1
                total, letters = np.zeros(width), False
                for at in range(0, len(words), CACHE_WORDS):
                    if len(words) > CACHE_WORDS:
                        index.clear()
                        index.used = 1
                    rows_ = np.fromiter((index[w] for w in words[at : at + CACHE_WORDS]), np.int64)
                    letters = letters or bool(rows_.any())
                    total += known[rows_].sum(axis=0)
                if not letters:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                names.append(made.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify_languages(
    docs: DataFrame, learn: Column, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the documents for which ``learn`` (on the id column) holds and label all of them."""
    model = fit_languages(docs.where(learn).select(lang_col, text_col), scratch, text_col, lang_col)
    return identify(docs, model, id_col, text_col)
