"""A causal self-attention model over classes of subword ids, in numpy, for use inside tasks.

The model has one attention layer.  As its inputs are classes, the projections of their
embeddings are kept as tables: queries, keys, values and a residual per class, and a bias
per distance.  Windows overlap: each holds `context` places of which the last `stride`
are predicted, so every token is scored once, with `context - stride` to `context - 1`
tokens before it where the text has them.

An input can be a class with further pieces, those that continue a word: its row of a table is then
that of the class plus the rows of its pieces, the n-th of them divided by n + 1.  ``more`` names them for all
inputs: the pieces end to end, and the bounds of each input's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import sqrt

import numpy as np

BLOCK_PLACES = 4096  # predicted places that are held at a time
RATE, BATCH_PLACES = 0.03, 256  # of Adam: step size, places per step


@dataclass(frozen=True)
class Shape:
    """Sizes of a model and of its windows."""

    classes: int
    width: int
    context: int
    stride: int
    later: int = 0  # classes of pieces that continue a word: the last rows of the tables of inputs

    @property
    def rows(self) -> int:
        return self.classes + self.later

    @cached_property
    def parts(self) -> dict[str, tuple[int, ...]]:
        table = (self.rows, self.width)
        return {
            "query": table, "key": table, "value": table, "last": table, "out": (self.classes, self.width),
            "bias": (self.classes,), "far": (self.context,),
        }

    @cached_property
    def places(self) -> dict[str, tuple[slice, tuple[int, ...]]]:
        out, at = {}, 0
        for name, shape in self.parts.items():
            size = int(np.prod(shape))
            out[name] = slice(at, at + size), shape
            at += size
        return out

    @property
    def length(self) -> int:
        return self.places["far"][0].stop

    @cached_property
    def distance(self) -> np.ndarray:
        return (self.context - self.stride + np.arange(self.stride))[:, None] - np.arange(self.context)[None, :]

    @cached_property
    def near(self) -> np.ndarray:
        return np.maximum(self.distance, 0)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[place].reshape(shape) for name, (place, shape) in self.places.items()}

    def start(self, log_share: np.ndarray, seed: int = 5) -> np.ndarray:
        """Parameters before training: small noise, nothing for further pieces, and the classes' log shares as bias."""
        rng = np.random.default_rng(seed)
        flat = (rng.standard_normal(self.length) * 0.1).astype(np.float32)
        parts = self.unpack(flat)
        for name in ("query", "key", "value", "last"):
            parts[name][self.classes :] = 0
        parts["far"][:] = 0
        parts["bias"][:] = log_share
        return flat

    def windows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts laid end to end: each window's text and first predicted place in it."""
        count = -(-lengths // self.stride)
        text = np.repeat(np.arange(len(lengths)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return text, nth * self.stride

    def gather(self, begin: np.ndarray, length: np.ndarray, place: np.ndarray):
        """Rows of the inputs (windows x context), which exist, and which predicted places exist."""
        at = place[:, None] + (np.arange(self.context) - (self.context - self.stride))[None, :]
        there = (at >= 0) & (at < length[:, None])
        return np.where(there, begin[:, None] + at, 0), there, there[:, self.context - self.stride :]


def stretch(count, nth: int, of: int) -> slice:
    """The ``nth`` of ``of`` consecutive stretches of so many items."""
    return slice(count * nth // of, count * (nth + 1) // of)


def _weights(bounds: np.ndarray, kind) -> np.ndarray:
    """What the row of each further piece is multiplied by, as a column."""
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
    return (1 / (nth + 2)).astype(kind)[:, None]


def together(table: np.ndarray, classes: np.ndarray, pieces: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Row of each input: that of its class, and those of its further pieces."""
    out, some = table[classes], np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] += np.add.reduceat(table[pieces] * _weights(bounds, table.dtype), bounds[some])
    return out


def _pieces_of(rows: np.ndarray, there: np.ndarray, pieces: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The further pieces of the inputs in ``rows``, and their bounds."""
    first = bounds[rows].ravel()
    count = np.where(there.ravel(), bounds[rows + 1].ravel() - first, 0)
    ends = np.r_[0, np.cumsum(count)]
    return pieces[np.repeat(first - ends[:-1], count) + np.arange(ends[-1])], ends


def scorer(shape: Shape, flat: np.ndarray):
    """A function from inputs, targets, starts, lengths and further pieces to the log probability of each token."""
    p = shape.unpack(flat.astype(np.float32))
    lead = shape.context - shape.stride
    scores = np.clip(p["query"] @ p["key"].T / np.sqrt(shape.width), -30, 30)
    table = np.exp(scores).astype(np.float32).ravel()
    width = np.float32(shape.width**-0.5)
    causal = shape.distance >= 0
    near = np.where(causal, np.exp(np.clip(p["far"], -30, 30))[np.where(causal, shape.distance, 0)], 0).astype(np.float32)
    # values with a column of ones, which sums the weights; the row after the last class is a gap
    value = np.zeros((shape.rows + 1, shape.width + 1), np.float32)
    value[:-1, :-1], value[: shape.classes, -1] = p["value"], 1
    out = np.concatenate([p["out"].T, p["bias"][None]]).astype(np.float32)
    ones, step = np.ones(shape.classes, np.float32), max(1, BLOCK_PLACES // shape.stride)

    def run(inputs: np.ndarray, targets: np.ndarray, begin: np.ndarray, length: np.ndarray, more=None) -> np.ndarray:
        result = np.zeros(len(inputs))
        text, place = shape.windows(length)
        if more is not None:
            query, key, last = (together(p[name], inputs, *more) for name in ("query", "key", "last"))
            query *= width
            held = np.concatenate([together(value, inputs, *more), value[-1:]])
        for at in range(0, len(text), step):
            t = text[at : at + step]
            rows, there, asked = shape.gather(begin[t], length[t], place[at : at + step])
            if more is None:
                x = inputs[rows].astype(np.int32)
                v = value[np.where(there, x, shape.rows)]
                q = x[:, lead:]
                w = table[q[:, :, None] * np.int32(shape.rows) + x[:, None, :]]
                own = p["last"][q[asked]]
            else:
                v = held[np.where(there, rows, len(inputs))]
                w = np.matmul(query[rows[:, lead:]], key[rows].transpose(0, 2, 1))
                np.exp(np.clip(w, -30, 30, out=w), out=w)
                own = last[rows[:, lead:][asked]]
            w *= near
            mixed = np.matmul(w, v)[asked]
            h = np.ones((len(mixed), shape.width + 1), np.float32)
            h[:, :-1] = mixed[:, :-1] / np.maximum(mixed[:, -1:], 1e-30) + own
            logits = h @ out
            want = rows[:, lead:][asked]
            chosen = logits[np.arange(len(logits)), targets[want]].astype(np.float64)
            np.exp(logits, out=logits)
            mass = logits @ ones
            if not np.isfinite(mass).all():
                logits = h @ out
                mass = np.exp(np.logaddexp.reduce(logits.astype(np.float64), axis=1))
            result[want] = chosen - np.log(mass)
        return result

    return run


@dataclass
class Trainer:
    """Adam on windows of one task's texts."""

    shape: Shape
    flat: np.ndarray
    steps: int = 0

    def __post_init__(self):
        self.flat = self.flat.astype(np.float32).copy()
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room = np.empty((0, self.shape.classes), np.float32)

    def learn(
        self, inputs: np.ndarray, targets: np.ndarray, begin: np.ndarray, length: np.ndarray, nth: int = 0, of: int = 1,
        times: np.ndarray | None = None, more: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> int:
        """One step per `BATCH_PLACES` places of each text's ``nth`` stretch of windows; returns how many tokens they predicted.

        ``times`` says how often each text occurs: it is gone through once, with that weight.
        """
        shape, seen = self.shape, 0
        text, place = shape.windows(length)
        if of > 1:
            part = stretch(-(-length // shape.stride), nth, of)
            window = place // shape.stride
            chosen = (window >= part.start[text]) & (window < part.stop[text])
            text, place = text[chosen], place[chosen]
        batch = max(1, BATCH_PLACES // min(shape.stride, max(1, int(length.mean()) if len(length) else 1)))
        if len(self.room) < batch * shape.stride:
            self.room = np.empty((batch * shape.stride, shape.classes), np.float32)
        for at in range(0, len(text), batch):
            t = text[at : at + batch]
            rows, there, asked = shape.gather(begin[t], length[t], place[at : at + batch])
            targets_here = targets[rows[:, shape.context - shape.stride :]]
            weight = None if times is None else times[t]
            here = None if more is None else _pieces_of(rows, there, *more)
            _, slope = loss_and_gradient(shape, self.flat, inputs[rows], there, asked, targets_here, weight, self.room, here)
            self.steps += 1
            seen += int(asked.sum()) if weight is None else int(asked.sum(axis=1) @ weight)
            # in place and with plain floats, so that single precision stays single
            self.first *= 0.9
            self.first += 0.1 * slope
            slope *= slope
            self.second *= 0.99
            self.second += 0.01 * slope
            np.sqrt(self.second, out=slope)
            slope += 1e-8 * sqrt(1 - 0.99**self.steps)
            np.divide(self.first, slope, out=slope)
            slope *= RATE / sqrt(1 + self.steps / 200) * sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.flat -= slope
        return seen


def _per_class(classes: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Sum the rows of each class."""
    width = rows.shape[1]
    cells = classes[:, None] * width + np.arange(width)
    return np.bincount(cells.ravel(), rows.ravel(), count * width).reshape(count, width)


def loss_and_gradient(shape: Shape, flat, x, there, asked, targets, times=None, room=None, more=None) -> tuple[float, np.ndarray]:
    """Mean loss over the asked places, and its gradient in all parameters.

    ``times`` weighs the windows; ``room`` is an array of classes per place that is written over; ``more`` has the
    further pieces of the inputs in ``x``.
    """
    p, kind, near = shape.unpack(flat), flat.dtype.type, shape.near
    lead = shape.context - shape.stride
    q, more_q = x[:, lead:], None
    if more is not None:
        count = np.diff(more[1]).reshape(x.shape)
        late = np.repeat(np.broadcast_to(np.arange(shape.context) >= lead, x.shape).ravel(), count.ravel())
        more_q = more[0][late], np.r_[0, np.cumsum(count[:, lead:])]

    def of(name: str, classes: np.ndarray, pieces) -> np.ndarray:
        return p[name][classes] if pieces is None else together(p[name], classes.ravel(), *pieces).reshape(*classes.shape, -1)

    query, key, v, last = of("query", q, more_q) * kind(shape.width**-0.5), of("key", x, more), of("value", x, more), of("last", q, more_q)
    open_ = (shape.distance >= 0)[None] & there[:, None, :] & asked[:, :, None]
    scores = np.matmul(query, key.transpose(0, 2, 1))
    scores += p["far"][near]
    scores[~open_] = -1e9
    scores -= scores.max(axis=2, keepdims=True)
    w = np.exp(scores, out=scores)
    w *= open_
    w /= np.maximum(w.sum(axis=2, keepdims=True), 1e-30)
    a = np.matmul(w, v)
    y = targets[asked]
    h = a[asked] + last[asked]
    here, ones = np.arange(len(y)), np.ones(shape.classes, flat.dtype)
    share = np.ones(len(y)) if times is None else np.repeat(times, asked.sum(axis=1)).astype(float)
    share = (share / max(1.0, share.sum())).astype(flat.dtype)
    z = np.matmul(h, p["out"].T, out=None if room is None else room[: len(y)])
    z += p["bias"]
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    mass = z @ ones
    if not (np.isfinite(mass).all() and mass.min(initial=1.0) > 1e-30):  # lowered by the maxima, then
        np.matmul(h, p["out"].T, out=z)
        z += p["bias"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        mass = z @ ones
    loss = float(-(np.log(np.maximum(z[here, y] / mass, 1e-30)) * share).sum())
    z *= (share / mass)[:, None]
    z[here, y] -= share
    grad = np.zeros(shape.length, flat.dtype)
    g = shape.unpack(grad)
    g["out"][:] = z.T @ h
    g["bias"][:] = z.sum(axis=0)
    dh = z @ p["out"]
    da = np.zeros_like(a)
    da[asked] = dh
    dv = np.matmul(w.transpose(0, 2, 1), da)
    dw = np.matmul(da, v.transpose(0, 2, 1))
    dw -= (dw * w).sum(axis=2, keepdims=True)
    dw *= w
    g["far"][:] = np.bincount(near.ravel(), dw.sum(axis=0).ravel(), shape.context)
    dq = np.matmul(dw, key) * kind(shape.width**-0.5)
    dk = np.matmul(dw.transpose(0, 2, 1), query)
    if more is None:
        asked_rows = ("last", dh, q[asked], None), ("query", dq[asked], q[asked], None)
    else:
        asked_rows = ("last", da, q, more_q), ("query", dq, q, more_q)
    for name, rows, classes, pieces in (*asked_rows, ("value", dv, x, more), ("key", dk, x, more)):
        classes, rows = classes.ravel(), rows.reshape(-1, shape.width)
        if pieces is not None:
            each = np.repeat(rows, np.diff(pieces[1]), axis=0) * _weights(pieces[1], kind)
            classes, rows = np.r_[classes, pieces[0]], np.concatenate([rows, each])
        g[name][:] = _per_class(classes, rows, shape.rows)
    return loss, grad
