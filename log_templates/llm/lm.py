"""Language-model scoring: a word model over all counts, and causal attention on subword ids.

The corpus statistics come from every training text: the count of every word, and from
those the counts of the subword ids that begin and that continue a word.  Attention is
masked in two ways, by two models of one kind.  `OUTER` predicts the id that begins a
word, or the end of the text, from all ids of the words before it; `INNER`
predicts the ids that continue a word, and its end, from the ids before them in the word.
So what `INNER` gives a word is the same wherever the word stands, and a task computes it
once per distinct word.  Both predict classes of ids: the most frequent ids are classes
of their own, the others share classes by the way they begin, and inside a class an id
has its share of the counts.

They are trained by parallel gradient descent: each task takes steps on its own rows, and
the tasks' parameters are averaged by Spark, in `ROUNDS` rounds.  A round of `OUTER`
takes the next of `ROUNDS` consecutive stretches of every training text, so the rounds
together see every word of every training text once.  `INNER` does not depend on where a
word stands, so it learns from the distinct words, each with its count as weight; a round
takes one of `ROUNDS` parts of them.

Scoring cuts each text into overlapping windows (see `attention`); each token is scored
once.  The probability of a word is that of its class after the words before it, by
`OUTER`, times its share of the class.  That share is the add-one share of the class's training words,
and, as far as words of the class were new when they came, what `INNER` gives its spelling; the weight of
either follows from the class's counts (see `ClassWords`).  The sum of the logs, with the end of the text by
`OUTER`, is the model's log10 probability.

A word's share of its class is the same wherever it stands, so it is found once per distinct word of all
texts.  Texts are cut into words twice: to count them, and to write the classes of all their ids, one byte each, from
which `OUTER` is trained and scores.  A word before is one place of its windows, whatever its number of ids: the
class of the id that begins it, and all those that continue it.  The shares of frequent words, of which there can be at most
1 / `HOT_SHARE`, travel with the tasks; the others are joined by Spark.

Defined results.  A null text counts as empty and consists of the end alone.  A null id
counts as the empty text when the fold is chosen.  Ids may repeat: each row is scored.
With nothing to learn from all counts are 0 and the model has its start parameters.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass, replace
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from log_templates.llm import attention
from log_templates.llm.common import Scratch, slices

PATTERN = r" [^ ]*"  # words come already cut, each after a space
HOT_SHARE = 1e-6
SLICE_BYTES = 4 << 20  # of texts whose words a task holds at a time
LEARN_WORDS = 50_000  # words of texts that a task holds before it learns from them
ROUNDS = 2
INNER = attention.Shape(classes=256, width=16, context=8, stride=4)
OUTER = attention.Shape(classes=128, width=16, context=16, stride=8, later=INNER.classes)
SHARED = 24  # classes that ids without one of their own share
END = 0  # class of the end of a text or of a word


LN10 = np.log(10)


def either(count, slot, spelling):
    """log10 probability of words from their counts, by the log10 of what each count has and of what spelling has."""
    return np.log10(np.power(10.0, slot) * (count + 1.0) + np.power(10.0, spelling))


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words with A-Z in lower case, cut at ASCII white space, of all texts end to end, and the bounds of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    bounds = np.r_[0, np.cumsum(real)][lists.offsets.to_numpy()]
    return bounds, words.filter(pa.array(real))


def of_size(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a part hold about `SLICE_BYTES`, one text at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes) -> tiktoken.Encoding:
    """A byte-level tokenizer from the content of its ranks file."""
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def starts_word(encoding: tiktoken.Encoding) -> np.ndarray:
    """For each id, whether its piece begins with a space: only the first piece of a word does."""
    out = np.zeros(encoding.n_vocab, bool)
    for k in range(encoding.n_vocab):
        with suppress(KeyError):
            out[k] = encoding.decode_single_token_bytes(k)[:1] == b" "
    return out


def encode_words(encoding: tiktoken.Encoding, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words laid end to end, and the number of ids of each."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = (b" " + b" ".join(words)).decode("utf-8", "replace")
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    first = np.flatnonzero(starts_word(encoding)[ids])
    return ids, np.diff(np.append(first, len(ids)))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts, and how often they occur in those to learn from."""
    for part in of_size(batches):
        bounds, words = word_lists(part.column("text"))
        coded = words.dictionary_encode()
        learn = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), np.diff(bounds))
        n = np.bincount(coded.indices.to_numpy(), learn, len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n.astype(np.int64))], names=["word", "n"])


@dataclass(frozen=True)
class Classes:
    """Class of each id, the log share of an id inside its class, and the classes' log shares."""

    of_id: np.ndarray
    log_share: np.ndarray
    log_class: np.ndarray


def make_classes(shape: attention.Shape, counts: np.ndarray, ends: int, group: np.ndarray) -> Classes:
    """``group`` is a number for each id that says which ids without a class of their own share one."""
    single = min(shape.classes - SHARED - 1, len(counts))
    order = np.lexsort((np.arange(len(counts)), -counts))
    of_id = shape.classes - SHARED + group % SHARED
    of_id[order[:single]] = 1 + np.arange(single)
    smooth = counts + 1.0
    total = np.bincount(of_id, smooth, shape.classes)
    total[END] = ends + 1.0
    return Classes(
        of_id.astype(np.int64), np.log(smooth / total[of_id]),
        np.log(np.maximum(total, 1.0) / total.sum()).astype(np.float32),
    )


@dataclass(frozen=True)
class ClassWords:
    """Training words by the class of their first id: occurrences, and distinct words.

    Of a class with ``n`` occurrences of ``d`` distinct words, the share ``(d + 1) / (n + d + 2)`` goes to
    spelling (Witten and Bell's estimate of how often the next word is new, with one added to
    either side).  The rest goes by ``(count + 1) / (n + d + 1)`` to the words, unseen ones together being one of them.
    """

    seen: np.ndarray
    distinct: np.ndarray

    def slot(self) -> np.ndarray:
        """log10 share of a word of each class per count, one added."""
        n, d = self.seen.astype(float), self.distinct.astype(float)
        return np.log10((n + 1) / (n + d + 2) / (n + d + 1))

    def spelled(self) -> np.ndarray:
        """log10 share of spelling of each class."""
        n, d = self.seen.astype(float), self.distinct.astype(float)
        return np.log10((d + 1) / (n + d + 2))


@dataclass(frozen=True)
class LanguageModel:
    total: int  # tokens of the training texts
    distinct: int
    ends: int
    hot: dict[bytes, int]  # frequent words: their row in ``prices``
    outer: Classes
    inner: Classes
    flat: tuple[np.ndarray, np.ndarray]  # parameters of the outer and the inner model
    by_class: ClassWords | None = None
    prices: tuple[np.ndarray, np.ndarray] | None = None  # base and share of frequent words; the last row is 0


def shifted(targets: np.ndarray, start: np.ndarray, first: np.ndarray | int) -> np.ndarray:
    """Inputs that predict ``targets``: the target before, and ``first`` at the start of a text."""
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[start] = first
    return inputs


def inside(ids: np.ndarray, start: np.ndarray, length: np.ndarray, inner: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets inside words laid end to end: the ids after the first, and the end."""
    inputs = inner.of_id[ids]
    targets = np.empty_like(inputs)
    targets[:-1] = inputs[1:]
    targets[start + length - 1] = END
    return inputs, targets


@dataclass(frozen=True)
class Pieces:
    """Words laid end to end: the class of the first id of each, and the classes of the others, after each word an `END`."""

    first: np.ndarray
    later: np.ndarray


def pieces_of(m: LanguageModel, ids: np.ndarray, length: np.ndarray) -> Pieces:
    start = np.cumsum(length) - length
    return Pieces(m.outer.of_id[ids[start]], inside(ids, start, length, m.inner)[1])


def between(first: np.ndarray, counts: np.ndarray):
    """The sequences of beginnings of texts with so many words each: inputs, targets, starts, lengths."""
    length = counts + 1
    start = np.cumsum(length) - length
    targets = np.full(int(length.sum()), END, np.int64)
    own = np.ones(len(targets), bool)
    own[start + counts] = False
    targets[own] = first
    return shifted(targets, start, END), targets, start, length


def sequences(texts: list[Pieces]):
    """What `OUTER` is asked of texts: inputs, targets, starts, lengths, and the ids that continue the word of each input."""
    inputs, targets, start, length = between(
        np.concatenate([t.first for t in texts]), np.array([len(t.first) for t in texts], np.int64)
    )
    later = np.concatenate([t.later for t in texts])
    ends = np.flatnonzero(later == END)
    count = np.zeros(len(inputs), np.int64)  # the first input of a text is no word
    of_word = np.ones(len(inputs), bool)
    of_word[start] = False
    count[of_word] = np.diff(np.r_[-1, ends]) - 1
    return inputs, targets, start, length, (later[later != END] + OUTER.classes, np.r_[0, np.cumsum(count)])


def _id_counts(counts: DataFrame, ranks, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of each subword id at the start of a word and later, and distinct words that start with it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, total = tokenizer(ranks.value), np.zeros(3 * vocabulary)
        for part in slices(batches, 4096):
            ids, length = encode_words(encoding, [w.encode() for w in part.column("word").to_pylist()])
            times = np.repeat(part.column("n").to_numpy(), length)
            later = np.ones(len(ids), np.int64)
            start = np.cumsum(length) - length
            later[start] = 0
            total[: 2 * vocabulary] += np.bincount(ids + vocabulary * later, times, 2 * vocabulary)
            total[2 * vocabulary :] += np.bincount(ids[start], minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen].astype(np.int64))], names=["id", "n"]
        )

    out = np.zeros(3 * vocabulary, np.int64)
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out[:vocabulary], out[vocabulary : 2 * vocabulary], out[2 * vocabulary :]


def learn_words(words: list[bytes], times: np.ndarray, inner: attention.Trainer, m: LanguageModel, encoding) -> int:
    """Steps over the insides of distinct words, each with the number of times it occurs; how many targets that are."""
    ids, length = encode_words(encoding, words)
    start = np.cumsum(length) - length
    return inner.learn(*inside(ids, start, length, m.inner), start, length, times=times)


def learn_beginnings(texts: Iterable[Pieces], outer: attention.Trainer, nth: int) -> int:
    """Steps over the ``nth`` stretch of each text, given as the classes of its ids; how many targets that are."""
    seen, held, size = 0, [], 0

    def learn() -> int:
        *asked, more = sequences(held)
        return outer.learn(*asked, nth, ROUNDS, more=more)

    for text in texts:
        held.append(text)
        size += len(text.first) + 1
        if size >= LEARN_WORDS:
            seen += learn()
            held, size = [], 0
    return seen + (learn() if held else 0)


def learn_texts(texts: Iterable[list[bytes]], m: LanguageModel, encoding: tiktoken.Encoding, nth: int):
    """Steps over the ``nth`` stretch of texts given as words: how many targets both models saw, and their parameters."""
    outer, inner = attention.Trainer(OUTER, m.flat[0]), attention.Trainer(INNER, m.flat[1])
    texts, times = list(texts), Counter()
    for words in texts:
        times.update(words[attention.stretch(len(words), nth, ROUNDS)])
    seen = (
        learn_beginnings((pieces_of(m, *encode_words(encoding, words)) for words in texts), outer, nth),
        learn_words(list(times), np.fromiter(times.values(), np.int64, len(times)), inner, m, encoding),
    )
    return *seen, np.concatenate([outer.flat, inner.flat])


def beginnings(m: LanguageModel, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Class of the first id of each word."""
    return m.outer.of_id[ids[np.cumsum(length) - length]]


def _averaged(parts: DataFrame, flat: np.ndarray) -> np.ndarray:
    """The tasks' parameters ``seen, flat`` averaged by what they saw; ``flat`` if there is no task."""
    each = parts.select("seen", F.posexplode("flat").alias("place", "value"))
    mean = each.groupBy("place").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value"))
    out = flat.copy()
    for r in mean.collect():  # one row per parameter, whatever the corpus
        out[r["place"]] = r["value"]
    return out


def _trained(seen: int, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], names=["seen", "flat"])


def _train_inner(counts: DataFrame, model: LanguageModel, ranks, nth: int) -> np.ndarray:
    """Each task steps from the same parameters over its distinct words; Spark averages the results."""
    send = counts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encoding, seen = send.value, tokenizer(ranks.value), 0
        inner = attention.Trainer(INNER, m.flat[1])
        for part in slices(batches, LEARN_WORDS):
            words = part.column("word").cast(pa.binary()).to_pylist()
            seen += learn_words(words, part.column("n").to_numpy(), inner, m, encoding)
        yield from _trained(seen, inner.flat)

    words = counts.where((F.col("n") > 0) & (F.pmod(F.xxhash64("word"), F.lit(ROUNDS)) == nth)).select("word", "n")
    return _averaged(words.mapInArrow(run, "seen long, flat array<float>"), model.flat[1])


def _written(part: pa.RecordBatch) -> Iterator[Pieces]:
    """Texts as `_classed` has written them."""
    for first, later in zip(part.column("classes").to_pylist(), part.column("later").to_pylist(), strict=True):
        yield Pieces(*(np.frombuffer(x, np.uint8).astype(np.int64) for x in (first, later)))


def _train_outer(train: DataFrame, flat: np.ndarray, nth: int) -> np.ndarray:
    """Each task steps from the same parameters over the ids of its texts; Spark averages the results."""
    send = train.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer = attention.Trainer(OUTER, send.value)
        texts = (text for part in slices(batches) for text in _written(part))
        yield from _trained(learn_beginnings(texts, outer, nth), outer.flat)

    return _averaged(train.select("classes", "later").mapInArrow(run, "seen long, flat array<float>"), flat)


def _priced(model, ranks):
    """For every word its class and the log10 of its share of the class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encoding = model.value, tokenizer(ranks.value)
        inner, of_slot, of_spelling = attention.scorer(INNER, m.flat[1]), m.by_class.slot(), m.by_class.spelled()
        for part in slices(batches, 16_384):
            ids, length = encode_words(encoding, part.column("word").cast(pa.binary()).to_pylist())
            start = np.cumsum(length) - length
            logs = inner(*inside(ids, start, length, m.inner), start, length)
            logs += m.inner.log_share[ids]
            logs[start] -= m.inner.log_share[ids[start]]  # the first id is not one of the inside
            rest = m.outer.log_share[ids[start]] + np.add.reduceat(logs, start)
            first = beginnings(m, ids, length)
            share = either(part.column("n").to_numpy(), of_slot[first], of_spelling[first] + rest / LN10)
            yield pa.RecordBatch.from_arrays(
                [part.column("word"), part.column("n"), pa.array(first, pa.int32()), pa.array(share)],
                names=["word", "n", "class", "share"],
            )

    return run, "word string, n long, class int, share double"


def fit_words(rows: DataFrame, learn: Column, ranks_file: bytes, scratch: Scratch) -> tuple[LanguageModel, DataFrame]:
    """The model without `OUTER`'s training, and ``word, n, class, share, base`` of all words of texts ``rows(doc_id, text)``."""
    spark = rows.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    counts = scratch.save(
        rows.select("text", learn.alias("learn")).mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")),
        "counts",
    )
    sums = counts.agg(F.sum("n").alias("words"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    ends = rows.where(learn).count()
    total = (sums["words"] or 0) + ends
    encoding, ranks = tokenizer(ranks_file), spark.sparkContext.broadcast(ranks_file)
    vocabulary = encoding.n_vocab
    group = np.zeros(vocabulary, np.int64)
    for k in range(vocabulary):
        try:
            piece = encoding.decode_single_token_bytes(k)
        except KeyError:
            continue
        group[k] = piece.lstrip(b" ")[:1][0] if piece.lstrip(b" ") else 0
    starts, later, distinct = _id_counts(counts.where("n > 0"), ranks, vocabulary)
    outer = make_classes(OUTER, starts, ends, group)
    inner = make_classes(INNER, later, int(starts.sum()), group)
    flat = (OUTER.start(outer.log_class), INNER.start(inner.log_class))
    of = lambda n: np.bincount(outer.of_id, n, OUTER.classes)
    by_class = ClassWords(of(starts), of(distinct))
    model = LanguageModel(total, sums["distinct"] + bool(ends), ends, {}, outer, inner, flat, by_class)
    for nth in range(ROUNDS if ends else 0):
        model = replace(model, flat=(flat[0], _train_inner(counts, model, ranks, nth)))
    run, schema = _priced(spark.sparkContext.broadcast(model), ranks)
    base = F.log10(F.col("n") + 1.0) - F.lit(log10(model.total + model.distinct + 1))
    words = scratch.save(counts.mapInArrow(run, schema).withColumn("base", base), "words")
    scratch.free(counts)
    frequent = list(words.where(F.col("n") >= F.lit(max(2.0, HOT_SHARE * total))).toLocalIterator())
    hot = {r["word"].encode(): k for k, r in enumerate(frequent)}
    column = lambda name, kind: np.array([*(r[name] for r in frequent), 0], kind)
    return replace(model, hot=hot, prices=(column("base", float), column("share", float))), words


def _classed(model, ranks, kind: str):
    """Texts as the classes of all ids of their words, the sums over frequent words, and the other words."""
    names = ["doc_id", "held_out", "n_tokens", "known", "base", "share", "rare", "classes", "later"]

    def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(values.astype(np.uint8))]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, encoding = model.value, tokenizer(ranks.value)
        hot_base, hot_share = m.prices
        end = (log10(m.ends + 1) - log10(m.total + m.distinct + 1), int(m.ends > 0))
        for part in of_size(batches):
            bounds, words = word_lists(part.column("text"))
            coded = words.dictionary_encode()
            distinct, index = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
            place = np.fromiter((m.hot.get(w, -1) for w in distinct), np.int64, len(distinct))
            ids, length = encode_words(encoding, distinct)
            pieces = pieces_of(m, ids, length)
            size = length[index]
            at = np.r_[0, np.cumsum(size)]
            later = pieces.later.astype(np.uint8)[np.repeat((np.cumsum(length) - length)[index] - at[:-1], size) + np.arange(at[-1])]
            here = place[index]
            sums = [np.diff(np.r_[0.0, np.cumsum(x)][bounds]) for x in (hot_base[here], hot_share[here])]
            others = np.r_[0, np.cumsum(here < 0)][bounds]
            n_words = np.diff(bounds)
            columns = [
                part.column("held_out"), pa.array(n_words + 1), pa.array(n_words - np.diff(others) + end[1]),
                pa.array(sums[0] + end[0]), pa.array(sums[1]),
                pa.ListArray.from_arrays(pa.array(others, pa.int32()), words.filter(pa.array(here < 0))),
                binary(pieces.first[index], bounds), binary(later, at[bounds]),
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    out = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, share double, "
    return run, out + "rare array<string>, classes binary, later binary"


def _score(send):
    """Adds what `OUTER` gives the beginnings of the words and the end of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = attention.scorer(OUTER, send.value)
        for part in slices(batches, 32):
            inputs, targets, start, length, more = sequences(list(_written(part)))
            logs = np.add.reduceat(predict(inputs, targets, start, length, more), start) / LN10
            yield part.drop_columns(["classes", "later"]).append_column("between", pa.array(logs))

    return run


def score_texts(
    docs: DataFrame, learn: Column, ranks_file: bytes, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every document.

    ``learn`` is a condition on `doc_id` that says which documents are training texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, words = fit_words(rows, learn, ranks_file, scratch)
    context = docs.sparkSession.sparkContext
    run, schema = _classed(context.broadcast(model), context.broadcast(ranks_file), rows.schema["doc_id"].dataType.simpleString())
    classed = rows.select("doc_id", (~learn).alias("held_out"), "text").mapInArrow(run, schema)
    classed = scratch.save(classed.withColumn("row", F.monotonically_increasing_id()), "classed", codec="zstd")
    flat = model.flat[0]
    for nth in range(ROUNDS if model.ends else 0):
        flat = _train_outer(classed.where(~F.col("held_out")), flat, nth)
    whole = classed.drop("rare")
    fields = ", ".join(f"{c} {kind}" for c, kind in whole.dtypes if c not in ("classes", "later"))
    scored = scratch.save(whole.mapInArrow(_score(context.broadcast(flat)), f"{fields}, between double"), "scored")
    rare = classed.select("row", F.explode("rare").alias("word")).join(words, "word")
    sums = rare.groupBy("row").agg(
        F.sum("base").alias("base_rare"), F.count_if(F.col("n") > 0).alias("known_rare"), F.sum("share").alias("share_rare")
    )
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"),
        (F.col("between") + F.col("share") + F.coalesce("share_rare", F.lit(0.0))).alias("score"),
    )
