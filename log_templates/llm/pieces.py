"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled into arcs: the normaliser (replacement rules, the leading space,
spaces as U+2581), one arc path per piece, and a byte path for characters that no piece
covers.  A text is composed with it lazily, state by state, and the path of least weight
in the tropical semiring gives the ids.

* A unigram model weighs a piece by minus its score; a state is a position.
* A merge (BPE) model is composed with an acceptor of neighbouring pieces: a pair passes
  only if merging its characters gives just that pair.  A sequence whose neighbours all
  pass is the one that merging produces, so the least path is the model's own encoding.
  A state is a position and the last piece.

Where no piece contains the two characters on both sides of a place, every path passes
that place, and the composition falls apart there: the parts are solved alone and
remembered, at most `CACHE_PARTS` of them.  Work is linear in the text, in tasks, without
a shuffle.

Defined results.  Null counts as empty, and an empty text has no ids.  A text of any
length is encoded whole.  Decoding gives the normalised text back; a literal U+2581 in
the input comes back as a space, as the format has it.  Other columns pass through
unchanged, repeated rows and null ids too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from log_templates.llm.common import slices

SPACE_MARK = "▁"
CACHE_PARTS = 300_000  # parts, and ids of them, that a task remembers; beyond it the cache starts anew
CACHE_IDS = 5_000_000
UNKNOWN_COST = 1e6  # of a character outside the vocabulary; any known path is cheaper

# fixed values of the model file format: piece types, and the model type of merges
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol buffer message, in order."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at : at + size]
        at += size


@dataclass
class Model:
    """What the transducer is compiled from."""

    pieces: list[tuple[str, float, int]]
    merges: bool
    byte_fallback: bool
    unknown_id: int
    dummy_prefix: bool = True
    squeeze_spaces: bool = False
    rules: dict[str, str] = field(default_factory=dict)


def read_model(data: bytes, rules: dict[str, str] | None = None) -> Model:
    """Parse a model file.  ``rules`` replaces a compiled character map, which is not read."""
    import struct

    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            pieces.append((part[1].decode(), struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0], part.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if normaliser.get(2) and rules is None:
        raise ValueError("the model has a character map; give its rules as a dict")
    return Model(
        pieces, trainer.get(3, 1) == MERGES, bool(trainer.get(35, 0)),
        next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), rules or {},
    )


class Transducer:
    """Normaliser, pieces and byte fallback, composed with one text at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.score = {}
        self.id_of = {}
        self.trie: dict = {}
        self.bytes_of: list[bytes] = []
        byte_ids = {}
        for i, (piece, score, kind) in enumerate(model.pieces):
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(b"" if kind in (CONTROL, UNKNOWN) else piece.encode())
            if kind in (NORMAL, USER_DEFINED):
                self.id_of[piece], self.score[piece] = i, score
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = i
        self.byte_ids = [byte_ids[b] for b in range(256)] if model.byte_fallback and len(byte_ids) == 256 else None
        self.passed: dict[int, dict[int, bool]] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.piece_bytes = pa.array(self.bytes_of, pa.large_binary())
        self._forget()
        self.inner = inner = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        spaces_lead = all(pair[1] != SPACE_MARK or pair[0] == SPACE_MARK for pair in inner)
        lines_alone = all("\n" not in pair for pair in inner)
        if spaces_lead and lines_alone:
            self.parts = re.compile(f"\n|{SPACE_MARK}+[^{SPACE_MARK}\n]*|[^{SPACE_MARK}\n]+").findall
        elif spaces_lead:
            self.parts = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+").findall
        else:
            self.parts = lambda text: [text]
        rules = sorted(model.rules, key=len, reverse=True)
        self.rewrite = re.compile("|".join(map(re.escape, rules))).sub if rules else None

    def normalise(self, text: str) -> str:
        if self.rewrite:
            text = self.rewrite(lambda m: self.model.rules[m[0]], text)
        if self.model.squeeze_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if text and self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE_MARK)

    def _split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge, the last one, makes this piece; none for a character."""
        if piece not in self.splits:
            parts = list(self.model.pieces[piece][0])
            while len(parts) > 2:
                scores = [self.score.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
                k = max((k for k, s in enumerate(scores) if s is not None), key=lambda k: scores[k])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.splits[piece] = (self.id_of[parts[0]], self.id_of[parts[1]]) if len(parts) == 2 else None
        return self.splits[piece]

    def _made_at(self, piece: int) -> float:
        return -1.0 if len(self.model.pieces[piece][0]) == 1 else -self.model.pieces[piece][1]

    def _passes(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces leaves just the two.

        Their own merges are undone, latest first; the pair fails if the pieces that then
        meet would have merged with each other before.  Of equal merges the left one is first.
        """
        pieces, bound, a, b = self.model.pieces, float("inf"), left, right
        while True:
            joined = self.score.get(pieces[a][0] + pieces[b][0])
            if joined is not None and -joined < bound:
                return False
            when_a, when_b = self._made_at(a), self._made_at(b)
            if when_a > when_b:
                bound, a = when_a, self._split(a)[1]
            elif when_b >= 0:
                bound, b = when_b + 0.5, self._split(b)[0]
            else:
                return True

    def shortest_path(self, text: str) -> tuple[int, ...]:
        """Ids on the least path through the composition of ``text`` with the transducer."""
        return self._path_of_pairs(text) if self.model.merges else self._path_of_weights(text)

    def _bytes(self, char: str) -> tuple[int, ...]:
        if not self.byte_ids:
            return (self.model.unknown_id,)
        return tuple(self.byte_ids[b] for b in char.encode("utf-8", "replace"))

    def _path_of_pairs(self, text: str) -> tuple[int, ...]:
        """Only one sequence of passing pairs reaches a place, so its state is the last piece."""
        n, trie, passed = len(text), self.trie, self.passed
        last: list[int | None] = [None] * (n + 1)
        start = [0] * (n + 1)
        last[0] = -1
        for i in range(n):
            before = last[i]
            if before is None:
                continue
            known = passed.setdefault(before, {})
            node = trie
            for j in range(i, n):
                node = node.get(text[j])
                if node is None:
                    break
                piece = node.get("")
                if piece is None or last[j + 1] is not None:
                    continue
                ok = known.get(piece)
                if ok is None:
                    ok = known[piece] = before < 0 or self._passes(before, piece)
                if ok:
                    last[j + 1], start[j + 1] = piece, i
            if last[i + 1] is None and (text[i] not in trie or "" not in trie[text[i]]):
                last[i + 1], start[i + 1] = -2, i  # the byte path; any piece may follow it
        out: list[tuple[int, ...]] = []
        at = n
        while at > 0:
            out.append((last[at],) if last[at] >= 0 else self._bytes(text[at - 1]))
            at = start[at]
        return tuple(i for ids in reversed(out) for i in ids)

    def _path_of_weights(self, text: str) -> tuple[int, ...]:
        n, trie = len(text), self.trie
        best = [float("inf")] * (n + 1)
        back: list[tuple[int, int]] = [(0, -2)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, j = trie, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None and best[i] - self.model.pieces[piece][1] < best[j]:
                    best[j], back[j] = best[i] - self.model.pieces[piece][1], (i, piece)
            if (text[i] not in trie or "" not in trie[text[i]]) and best[i] + UNKNOWN_COST < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + UNKNOWN_COST, (i, -2)
        out: list[tuple[int, ...]] = []
        at = n
        while at > 0:
            before, piece = back[at]
            out.append((piece,) if piece >= 0 else self._bytes(text[before]))
            at = before
        return tuple(i for ids in reversed(out) for i in ids)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.paths: dict[str, tuple[int, ...]] = {}
        self.flat, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _path(self, part: str) -> tuple[int, ...]:
        """Ids of a part, from those between the places that no piece reaches across."""
        inner, paths, at, out = self.inner, self.paths, 0, ()
        for k in range(1, len(part) + 1):
            if k == len(part) or part[k - 1 : k + 1] not in inner:
                found = paths.get(part[at:k])
                if found is None:
                    found = paths[part[at:k]] = self.shortest_path(part[at:k])
                out += found
                at = k
        return out

    def _learn(self, parts: list[str]) -> None:
        """Remember the least paths of new parts: where their ids stand and how many there are."""
        ids = [self._path(p) for p in parts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.number.update(zip(parts, range(len(self.at), len(self.at) + len(parts)), strict=True))
        self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where those of each end.

        Each distinct part of the texts is looked up once; the rest is done on arrays.
        """
        of_text = [self.parts(self.normalise(t or "")) for t in texts]
        parts = list(chain.from_iterable(of_text))
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        size = self.size[number]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(done[-1]) + np.repeat(self.at[number] - done[:-1], size)]
        ends = done[np.cumsum([0, *map(len, of_text)])]
        if len(self.at) > CACHE_PARTS or len(self.flat) > CACHE_IDS:
            self._forget()
            self.passed.clear()
        return ids, ends

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """The output side of the transducer read backwards: pieces and bytes to text."""
        pieces = self.piece_bytes.take(ids)
        _, offsets, data = pieces.buffers()
        at = np.frombuffer(offsets, np.int64, len(pieces) + 1)[ends].tolist() if len(pieces) else [0] * len(ends)
        data = memoryview(data or b"")
        cut = 1 if self.model.dummy_prefix else 0
        texts = (
            str(data[a:b], "utf-8", "replace").replace(SPACE_MARK, " ") for a, b in zip(at[:-1], at[1:], strict=True)
        )
        return [t[cut:] if t[:1] == " " else t for t in texts]

    def decode(self, ids: Iterable[int]) -> str:
        ids = pa.array(list(ids), pa.int64())
        return self.decode_all(ids, np.array([0, len(ids)]))[0]


@lru_cache(maxsize=2)
def _compiled(data: bytes, rules: tuple[tuple[str, str], ...] | None) -> Transducer:
    return Transducer(read_model(data, dict(rules) if rules is not None else None))


def _rules_key(rules: dict[str, str] | None):
    return None if rules is None else tuple(sorted(rules.items()))


def encode_pieces(
    docs: DataFrame, model: bytes, text_col: str = "text", out: str = "ids", rules: dict[str, str] | None = None
) -> DataFrame:
    """Add the array of ids of each text, in place of a column of that name.

    ``model`` is the content of a model file: a fixed file of well under a megabyte that
    travels with the tasks.
    """
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    send, key = docs.sparkSession.sparkContext.broadcast(model), _rules_key(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compiled(send.value, key)
        for part in slices(batches):
            ids, ends = made.encode_all(part.column(text_col).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            columns = [part.column(c) for c in kept] + [lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return docs.mapInArrow(run, schema)


def decode_pieces(
    docs: DataFrame, model: bytes, ids_col: str = "ids", out: str = "decoded", rules: dict[str, str] | None = None
) -> DataFrame:
    """Add the text that each array of ids stands for; null ids give the empty text."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.StringType())])
    send, key = docs.sparkSession.sparkContext.broadcast(model), _rules_key(rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _compiled(send.value, key)
        for part in slices(batches):
            ids = part.column(ids_col)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            texts = made.decode_all(ids.flatten(), ends)
            columns = [part.column(c) for c in kept] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return docs.mapInArrow(run, schema)


def normalised(text: Column, squeeze: bool = False) -> Column:
    """What decoding should give for a model without rules, as a Spark column."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, " +", " ")) if squeeze else text


__all__ = ["Model", "Transducer", "decode_pieces", "encode_pieces", "normalised", "read_model"]
