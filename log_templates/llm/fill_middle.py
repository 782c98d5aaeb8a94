"""Fill-in-the-middle examples: a text is cut in three and its parts change places.

A column of UTF-8 texts is worked on as one byte buffer.  Where a text is plain ASCII a
code point and a byte have the same number; only the multibyte characters are recorded,
each with its position and the bytes it has beyond the first.  A cut is carried from one
count to the other by looking up how many excess bytes lie before it, so the cost of a
conversion follows the exceptions and not the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from log_templates.llm.common import slices

# fixed values: the markers, and which bytes count as white space
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rates:
    """Percent of texts that are cut, percent of those that put the suffix first, and where cuts fall."""

    cut: int = 50
    suffix_first: int = 80
    at_chars: bool = False  # cuts before any code point instead of between units


class ExceptionIndex:
    """The multibyte characters of one text: code point numbers and bytes in excess of one.

    ``excess[k]`` is the sum over the first ``k`` exceptions.  Before the first of them,
    and between them, both numbers differ by a constant.
    """

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        value = data[lead]
        each = 1 + (value >= 0xE0).astype(np.int64) + (value >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(each)])
        self.byte_at = lead
        self.char_at = lead - self.excess[:-1]

    def to_byte(self, chars: np.ndarray) -> np.ndarray:
        """Byte offsets of cuts before the given code points."""
        return chars + self.excess[np.searchsorted(self.char_at, chars)]

    def to_char(self, at: np.ndarray) -> np.ndarray:
        """Code point numbers of cuts at the given byte offsets, each at a character's edge."""
        return at - self.excess[np.searchsorted(self.byte_at, at)]


def unit_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of all texts in one buffer, and each text's first place among them.

    A unit is a word with the white space before it; white space that ends a text is one more.
    ``starts`` has a text's first byte, and at last the buffer's length.
    """
    solid = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    filled = np.flatnonzero(np.diff(starts) > 0)
    text_end = np.zeros(len(data), bool)
    text_end[starts[filled + 1] - 1] = True
    closes = text_end.copy()
    closes[:-1] |= solid[:-1] & ~solid[1:]
    ends = np.flatnonzero(closes) + 1
    return ends, np.searchsorted(ends, starts, side="right")


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the digest of seed and key."""
    digest = sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def _arranged(whole: bytes, form: str, a: int, b: int) -> bytes:
    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == PSM:
        return p + prefix + s + suffix + m + middle
    return s + suffix + p + prefix + m + middle


def fill_in_middle(
    docs: DataFrame, seed: str = "42", rates: Rates | None = None, id_col: str = "doc_id", text_col: str = "text",
    out: str = "_fim",
) -> DataFrame:
    """Add the struct ``out``: units, form, cuts in code points and bytes, and the arranged text.

    The draws are the first four 32-bit numbers of the sha256 of ``seed:id``; the first two,
    modulo units + 1 (or code points + 1), give the cuts; equal ones leave the middle empty.  A null text is empty; empty texts and texts that hold a
    marker are ``plain`` and stay as they are, with null cuts.  A null id draws as an empty
    one.  Rows that repeat an id draw the same numbers, whole repeated rows give equal rows.
    Texts of any length are cut whole; all other columns are kept, and ``out`` replaces a
    column of its name.  Narrow: no row leaves its partition.
    """
    rates = rates or Rates()
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [
            T.StructField(
                out,
                T.StructType.fromDDL(
                    "n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, "
                    "middle_bytes long, output string"
                ),
            )
        ]
    )
    struct = pa.struct(
        [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
         ("prefix_bytes", pa.int64()), ("middle_bytes", pa.int64()), ("output", pa.string())]
    )
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def one(whole: bytes, key: str, ends: np.ndarray, at: int) -> tuple:
        """The form, the four lengths and the arranged bytes of one text; ``at`` is its place in the buffer."""
        n = len(ends)
        first, second, whether, which = draws(seed, key)
        if not n or whether % 100 >= rates.cut or any(m in whole for m in marks):
            return PLAIN, None, None, None, None, whole
        index = None if whole.isascii() else ExceptionIndex(np.frombuffer(whole, np.uint8))
        if rates.at_chars:
            chars = len(whole) - int(index.excess[-1]) if index else len(whole)
            ca, cb = sorted((first % (chars + 1), second % (chars + 1)))
            a, b = index.to_byte(np.array([ca, cb])).tolist() if index else (ca, cb)
        else:
            low, high = sorted((first % (n + 1), second % (n + 1)))
            a, b = (int(ends[k - 1]) - at if k else 0 for k in (low, high))
            ca, cb = index.to_char(np.array([a, b])).tolist() if index else (a, b)
        form = SPM if which % 100 < rates.suffix_first else PSM
        return form, ca, cb - ca, a, b - a, _arranged(whole, form, a, b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(text_col).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            starts = np.cumsum([0, *map(len, texts)])
            ends, place = unit_ends(np.frombuffer(b"".join(texts), np.uint8), starts)
            keys = ["" if k is None else str(k) for k in part.column(id_col).to_pylist()]
            made = [
                one(texts[k], keys[k], ends[place[k] : place[k + 1]], int(starts[k])) for k in range(len(texts))
            ]
            form, ca, cm, ba, bm, output = zip(*made, strict=True) if made else ((),) * 6
            columns = [
                pa.array(np.diff(place), pa.int64()), pa.array(form, pa.string()), *(
                    pa.array(x, pa.int64()) for x in (ca, cm, ba, bm)
                ), pa.array(output, pa.binary()).cast(pa.string()),
            ]
            added = pa.StructArray.from_arrays(columns, fields=list(struct))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), added], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an arranged output stands for.

    No part holds a marker and none can arise at a seam, so the first of each is the seam.
    """
    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.length(before(text, mark)) + len(mark) + 1, F.length(text))

    inner = after(output, PREFIX)
    psm = F.concat(before(inner, SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(inner, MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
