"""Examples packed into sequences under limits on tokens, segments and loss-bearing tokens at once.

Each example is a vector of three demands, each a share of its limit.  A sequence is
filled greedily: of the examples that still fit, the one whose weighted dot product with
the room that is left is largest goes in, so an example that is heavy where there is room
goes before one that is heavy where there is little.  A demand's weight is its average over
the examples.

Spark cuts the examples into cells of bounded size by a hash and packs every cell alone;
only what is shorter than a sequence travels there.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from log_templates.llm.common import Scratch, slices

CACHE_PARTS = 1_000_000  # parts of words, and ids, that a task remembers; beyond it the cache starts anew
CACHE_IDS = 20_000_000
JOINED_PARTS = 2_000
CELL_ROWS = 4096  # examples packed together; a cell holds less than a sequence of each
PIECE = "start long, length long, free long, doc_tokens long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold.  ``cut`` lets an example be divided to leave no padding."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    cut: bool = True


# --- from text to ids --------------------------------------------------------------------


# classes of bytes: white space, ASCII letters, digits, other ASCII, and what must stay with its neighbours
_WHITE, _LETTER, _DIGIT, _SIGN, _BOUND = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _WHITE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[0x27, *range(0x80, 0x100), *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = _BOUND


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte; Latin letters of two bytes (U+00C0 to U+01FF) count as letters."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC7))
    follow = data[lead + 1]
    # the signs of multiplication and division, and the dotted I, whose small form is two characters
    odd = ((data[lead] == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) | ((data[lead] == 0xC4) & (follow == 0xB0))
    lead = lead[~odd]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of stretches given by start and size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


_SIGNS = re.compile(rb"[!-&(-/:-@\[-`{-~]+").fullmatch


def _one_kind(part: bytes) -> bool:
    """Whether a part is Latin letters alone or signs alone, so that it makes one word of the tokenizer."""
    if part.isascii():
        return bool(_SIGNS(part))
    text = part.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0200" and "\u0130" not in text


class WordIds:
    """Ids of texts by a tokenizer that drops white space and splits words by kind of character.

    A batch of texts is one buffer.  It is cut at white space and, between plain characters, where
    their kind changes, as the tokenizer itself does; parts with an apostrophe or with
    characters outside the Latin letters stay whole.  Each distinct part is encoded once and
    remembered; new parts of one kind go to the library joined by blanks, and their ids
    come apart at the ids that end a word.
    """

    def __init__(self, tokenizer_json: bytes):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        plain, odd = [], []
        for part in new:
            (plain if part.isalnum() or _one_kind(part) else odd).append(part)
        flats, sizes = [], []
        for k in range(0, len(plain), JOINED_PARTS):
            some = plain[k : k + JOINED_PARTS]
            flat, size = self._joined(some)
            if len(size) != len(some):
                flat, size = self._each(some)
            flats.append(flat)
            sizes.append(size)
        flat, size = self._each(odd)
        size = np.concatenate([*sizes, size])
        at = np.cumsum(size) - size + len(self.flat)
        self.known.update(zip(plain + odd, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, *flats, flat])
        self.at, self.size = np.concatenate([self.at, at]), np.concatenate([self.size, size])

    def _joined(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join(parts).decode("utf-8", "replace")
        flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return flat, np.diff(np.flatnonzero(self.ends_word[flat]) + 1, prepend=0)

    def _each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text begins and ends; null has none."""
        raw = pc.fill_null(texts, "").cast(pa.large_binary())
        edges = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        kind = _classes(data) if b"<|" not in data.tobytes() else np.where(_CLASS[data] == _WHITE, _WHITE, _BOUND)
        solid = kind != _WHITE
        begins = solid.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        # next to a bound character only white space divides
        begins[1:] &= (kind[:-1] == _WHITE) | ((kind[1:] != _BOUND) & (kind[:-1] != _BOUND))
        first = edges[:-1][np.diff(edges) > 0]
        begins[first] |= solid[first]
        start = np.flatnonzero(begins)
        # offsets among the bytes that are left when white space is taken out
        place = np.concatenate([[0], np.cumsum(solid)])
        offsets = np.append(place[start], place[-1]).astype(np.int64)
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]
        )
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [p for p in distinct if p not in known]
        if new:
            self._learn(new)
        number = np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))
        code = number[coded.indices.to_numpy()] if len(start) else np.empty(0, np.int64)
        size = self.size[code]
        ids = self.flat[_ragged(self.at[code], size)]
        done = np.concatenate([[0], np.cumsum(size)])
        if len(known) > CACHE_PARTS or len(self.flat) > CACHE_IDS:
            self._forget()
        return ids, done[np.searchsorted(start, edges)]


@lru_cache(maxsize=2)
def _tokenizer(data: bytes) -> WordIds:
    return WordIds(data)


def _stretches(n: int, free: int, limits: Limits) -> Iterator[tuple[int, int]]:
    """Cut an example where a sequence's tokens or loss-bearing tokens would end."""
    start = 0
    while start < n:
        end = min(n, start + limits.tokens, max(start, free) + limits.loss)
        yield start, end
        start = end


def encode_examples(
    rows: DataFrame, tokenizer_json: bytes, limits: Limits, id_col: str = "doc_id", text_col: str = "text",
    prompt_col: str | None = None, end_id: int = 1,
) -> DataFrame:
    """id, start, length, free, doc_tokens and ids (little-endian unsigned 32-bit) of each piece of an example.

    An example is the ids of its prompt, if there is one, of its text, and ``end_id``; only
    the ``free`` ids of the prompt bear no loss.  Longer examples than a sequence can hold are
    cut at its limits.  ``copy`` numbers equal rows of a task, so that they can be dealt apart.
    """
    id_field = rows.schema[id_col]
    schema = T.StructType([T.StructField("id", id_field.dataType), *T.StructType.fromDDL(PIECE + ", copy long")])
    send = rows.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], "<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = _tokenizer(send.value), Counter()
        for part in slices(batches):
            texts, ends = made.texts(part.column(text_col))
            prompts, prompt_ends = made.texts(part.column(prompt_col)) if prompt_col else (texts, np.zeros_like(ends))
            source, out = [], []
            for k, key in enumerate(part.column(id_col).to_pylist()):
                prompt = prompts[prompt_ends[k] : prompt_ends[k + 1]]
                ids = np.concatenate([prompt, texts[ends[k] : ends[k + 1]], end]).astype("<u4")
                data = ids.tobytes()
                same = (key, crc32(data))
                for a, b in _stretches(len(ids), len(prompt), limits):
                    source.append(k)
                    free = min(max(len(prompt) - a, 0), b - a)
                    out.append((a, b - a, free, len(ids), data[4 * a : 4 * b], seen[same]))
                seen[same] += 1
            start, length, free, total, ids, copy = zip(*out, strict=True) if out else ((),) * 6
            numbers = [pa.array(x, pa.int64()) for x in (start, length, free, total)]
            columns = [part.column(id_col).take(pa.array(source, pa.int64())), *numbers, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(copy, pa.int64())], names=[f.name for f in schema.fields]
            )

    return rows.select(*{id_col, text_col, prompt_col or text_col}).mapInArrow(run, schema)


# --- packing -----------------------------------------------------------------------------


class Pool:
    """Pieces that wait, by kind: tokens and loss-bearing tokens.  Equal kinds wait in order."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.kinds: list[tuple[int, int]] = []  # largest first
        self.waiting: list[list[tuple]] = []
        self.weights = np.ones(3)
        self._sizes()

    def fill(self, pieces: list[tuple[int, int, int, int]]) -> None:
        """``pieces`` are (row, start, length, free); earlier ones leave first."""
        by_kind: dict[tuple[int, int], list[tuple]] = {}
        for piece in pieces:
            by_kind.setdefault((piece[2], piece[2] - piece[3]), []).append(piece)
        self.kinds = sorted(by_kind, reverse=True)
        self.waiting = [by_kind[k][::-1] for k in self.kinds]
        self._sizes()
        self.weights = np.average(self.demand, axis=0, weights=[len(w) for w in self.waiting]) if pieces else np.ones(3)

    def _sizes(self) -> None:
        both = np.array(self.kinds, np.int64).reshape(-1, 2)
        self.tokens, self.loss = both[:, 0], both[:, 1]
        one = np.full(len(self.kinds), 1 / self.limits.segments)
        self.demand = np.column_stack([self.tokens / self.limits.tokens, one, self.loss / self.limits.loss])

    def __bool__(self) -> bool:
        return bool(self.kinds)

    def add(self, piece: tuple[int, int, int, int]) -> None:
        kind = (piece[2], piece[2] - piece[3])
        at = int(np.searchsorted(-self.tokens, -kind[0]))
        while at < len(self.kinds) and self.kinds[at] > kind:
            at += 1
        if at < len(self.kinds) and self.kinds[at] == kind:
            self.waiting[at].append(piece)
            return
        self.kinds.insert(at, kind)
        self.waiting.insert(at, [piece])
        self._sizes()

    def take(self, kind: int) -> tuple[int, int, int, int]:
        piece = self.waiting[kind].pop()
        if not self.waiting[kind]:
            del self.waiting[kind], self.kinds[kind]
            self.tokens, self.loss = np.delete(self.tokens, kind), np.delete(self.loss, kind)
            self.demand = np.delete(self.demand, kind, axis=0)
        return piece

    def best(self, room: np.ndarray) -> int | None:
        """The kind that fits and has the largest weighted dot product with the room; the larger one of equals."""
        if room[1] < 1:
            return None
        fits = np.flatnonzero((self.tokens <= room[0]) & (self.loss <= room[2]))
        if not len(fits):
            return None
        limits = self.limits
        score = self.demand[fits] @ (self.weights * room / (limits.tokens, limits.segments, limits.loss))
        return int(fits[np.argmax(score)])

    def largest_part(self, room: np.ndarray) -> tuple[int, int] | None:
        """The kind of which most tokens fit if it is cut, and how many; the larger one of equals."""
        if room[1] < 1 or not self.kinds:
            return None
        part = np.minimum(np.minimum(self.tokens, room[0]), self.tokens - self.loss + room[2])
        k = int(np.argmax(part))
        return (k, int(part[k])) if part[k] > 0 else None


def _divided(piece: tuple, first: int) -> tuple[tuple, tuple]:
    row, start, length, free = piece
    head = (row, start, first, min(free, first))
    return head, (row, start + first, length - first, free - head[3])


def pack(pieces: list[tuple[int, int, int, int]], limits: Limits) -> list[list[tuple[int, int, int, int]]]:
    """Sequences of pieces (row, start, length, free).

    With ``cut``, a sequence that no whole piece fits any more takes a part of one; one that
    still is not full is cut back to the largest power of two, which needs no padding, and the
    rest waits again.
    """
    pool, done = Pool(limits), []
    pool.fill(pieces)
    while pool:
        room = np.array([limits.tokens, limits.segments, limits.loss])
        held: list[tuple] = []

        def place(piece: tuple) -> None:
            held.append(piece)  # noqa: B023
            room[:] -= (piece[2], 1, piece[2] - piece[3])  # noqa: B023

        while (kind := pool.best(room)) is not None:
            place(pool.take(kind))
        if limits.cut and room[0] and (part := pool.largest_part(room)):
            head, rest = _divided(pool.take(part[0]), part[1])
            place(head)
            if rest[2]:
                pool.add(rest)
        filled = limits.tokens - int(room[0])
        if limits.cut and room[0]:
            over = filled - (1 << (filled.bit_length() - 1))
            while over:
                last = held.pop()
                if last[2] > over:
                    head, last = _divided(last, last[2] - over)
                    held.append(head)
                pool.add(last)
                over -= last[2]
        done.append(held)
    return done


def pack_examples(pieces: DataFrame, scratch: Scratch, limits: Limits, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Give every piece of ``encode_examples`` a sequence and its place there, cutting pieces if allowed.

    Returns id, start, length, loss_tokens, doc_tokens, ids, sequence_id, offset and segment (its
    number in the sequence).  A piece that fills a sequence is one at once and stays where it is;
    all others go to cells of about ``cell_rows``, by a hash of id, place, content and the number of
    the copy, so that neither an id nor a text that fills a third of the table fills a cell.
    A cell is packed in an order given by its content, so a task that is run again gives
    the same sequences.  Sequence numbers are unique and have gaps.
    """
    pieces = scratch.save(pieces, "pieces", codec="zstd")
    full = pieces.where(F.col("length") == limits.tokens).select(
        "id", "start", "length", (F.col("length") - F.col("free")).alias("loss_tokens"), "doc_tokens", "ids",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(0).cast("long").alias("segment"),
    )
    rest = pieces.where(F.col("length") < limits.tokens)
    cells = max(1, -(-rest.count() // cell_rows))
    dealt = rest.withColumn(
        "cell", F.pmod(F.xxhash64("id", "start", F.crc32("ids"), "copy"), F.lit(cells).cast("long"))
    ).drop("copy")

    names = full.columns

    def pack_cell(cell: pa.Table) -> pa.Table:
        ids = cell["ids"].combine_chunks()
        data = ids.to_pylist()
        cell = cell.append_column("crc", pa.array([crc32(x) for x in data], pa.int64()))
        keys = [(c, "ascending") for c in ("id", "start", "crc", "free")]
        order = pc.sort_indices(cell, keys).to_pylist()
        start, length, free = (cell[c].to_pylist() for c in ("start", "length", "free"))
        # within a kind the first in order leaves first; kinds are met by size alone
        made = pack([(k, start[k], length[k], free[k]) for k in order], limits)
        base = cell["cell"][0].as_py() << 32
        rows, columns = [], [[] for _ in range(7)]
        for local, held in enumerate(made):
            offset = 0
            for segment, (row, at, size, unpaid) in enumerate(held):
                rows.append(row)
                skip = at - start[row]
                values = (
                    at, size, size - unpaid, data[row][4 * skip : 4 * (skip + size)], 2 * (base + local) + 1,
                    offset, segment,
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
                offset += size
        taken = cell.select(["id", "doc_tokens"]).take(pa.array(rows, pa.int64()))
        at, size, loss, parts, sequence, offset, segment = columns
        number = lambda x: pa.array(x, pa.int64())
        return pa.table(
            [taken["id"], number(at), number(size), number(loss), taken["doc_tokens"], pa.array(parts, pa.binary()),
             number(sequence), number(offset), number(segment)], names=names,
        )

    return full.unionByName(dealt.groupBy("cell").applyInArrow(pack_cell, full.schema))
