"""A small causal self-attention model in numpy.

It predicts the class of the next subword from the subwords before it: an
input is the embedding of its class, one of its id (ids share ``SLOTS`` rows)
and its position; then one attention head, a residual layer and a table of direct
class-to-class scores. Windows of ``WIDTH`` inputs begin ``STEP`` inputs after
one another and are computed in batches. A window scores the targets of its last
``STEP`` places, so each target counts once and sees at least ``WIDTH - STEP``
inputs where its text has them; before a text's start there is nothing to see.
"""

from __future__ import annotations

import math

import numpy as np

from codestrata.llm.common import ragged

WIDTH, STEP = 32, 16
BACK = WIDTH - STEP
SIZE = 16
CLASSES = 64
#: Input classes of a text's start, and of a place before it (seen by none).
START, NONE = CLASSES, CLASSES + 1
SLOTS = 512
#: Windows that are computed together, and rows that are multiplied together:
#: so few that a product stays in one thread, as the tasks fill the cores.
BATCH = 64
ROWS = 256
SHAPES = {
    "embed": (CLASSES + 1, SIZE),
    "own": (SLOTS, SIZE),
    "place": (WIDTH, SIZE),
    "query": (SIZE, SIZE),
    "key": (SIZE, SIZE),
    "value": (SIZE, SIZE),
    "mix": (SIZE, SIZE),
    "out": (SIZE, CLASSES),
    "direct": (CLASSES + 1, CLASSES),
}
#: Place j is seen from the last places i.
BEFORE = (np.arange(WIDTH) <= BACK + np.arange(STEP)[:, None]).astype(np.float32)
Weights = dict[str, np.ndarray]


def fresh(seed: int = 42) -> Weights:
    rng = np.random.default_rng(seed)
    made = {k: (rng.standard_normal(shape) * 0.2).astype(np.float32) for k, shape in SHAPES.items()}
    made["direct"][:] = made["own"][:] = 0
    return made


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unflat(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = np.asarray(values[at : at + n], np.float32).reshape(shape)
        at += n
    return out


def slots(ids: np.ndarray) -> np.ndarray:
    """The row of "own" for each id."""
    return (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int16)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, few rows at once."""
    return np.matmul(a.reshape(-1, math.gcd(len(a), ROWS), a.shape[1]), b).reshape(len(a), -1)


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, few rows at once."""
    rows = math.gcd(len(a), ROWS)
    return np.matmul(a.reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b.reshape(-1, rows, b.shape[1])).sum(axis=0)


def forward(w: Weights, inputs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, dict]:
    """Class scores of the last places, and what the gradient needs.
    ``inputs`` (classes) and ``own`` (slots) are (windows, WIDTH)."""
    n = len(inputs)
    table = np.vstack([w["embed"], np.zeros((1, SIZE), w["embed"].dtype)])
    x = table.take(inputs, axis=0)
    x += w["own"].take(own, axis=0)
    x += w["place"]
    last = np.ascontiguousarray(x[:, BACK:]).reshape(-1, SIZE)
    rows = x.reshape(-1, SIZE)
    q = np.tanh(times(last, w["query"])).reshape(n, STEP, SIZE)  # bounded, so that the exponents are
    k = np.tanh(times(rows, w["key"])).reshape(n, WIDTH, SIZE)
    v = np.empty((n, WIDTH, SIZE + 1), x.dtype)
    v[..., :SIZE] = times(rows, w["value"]).reshape(n, WIDTH, SIZE)
    v[..., SIZE] = 1  # its sum is that of the weights
    v *= (inputs != NONE)[..., None]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a *= x.dtype.type(SIZE**-0.5)
    np.exp(a, out=a)
    a *= BEFORE
    seen = np.matmul(a, v)
    total = seen[..., SIZE:]
    seen = seen[..., :SIZE] / total
    h = np.tanh(last + times(seen.reshape(-1, SIZE), w["mix"]))
    logits = times(h, w["out"])
    logits += w["direct"].take(inputs[:, BACK:].ravel(), axis=0, mode="clip")
    return logits, {"rows": rows, "last": last, "q": q, "k": k, "v": v, "a": a, "total": total, "seen": seen, "h": h}


def log_probs(w: Weights, inputs: np.ndarray, own: np.ndarray, targets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each target class, (windows, STEP), and of the
    classes of ``group`` (0 or 1 per class) together."""
    logits, _ = forward(w, inputs, own)
    if np.abs(w["out"]).sum(axis=0).max() + np.abs(w["direct"]).max() > 40:
        np.clip(logits, -40, 40, out=logits)
    said = logits[np.arange(len(logits)), targets.ravel()]
    np.exp(logits, out=logits)
    both = np.log(times(logits, np.column_stack([np.ones(CLASSES, logits.dtype), group.astype(logits.dtype)])))
    return (said - both[:, 0]).reshape(targets.shape), (both[:, 1] - both[:, 0]).reshape(targets.shape)


def _sums(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by index."""
    order = np.argsort(at, kind="stable")
    key = at[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.zeros((rows, values.shape[1]), values.dtype)
    out[key[heads]] = np.add.reduceat(values.take(order, axis=0), heads, axis=0)
    return out


def gradient(w: Weights, inputs: np.ndarray, own: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> Weights:
    """Gradient of the mean loss over the places where ``counts`` is true."""
    n = len(inputs)
    logits, s = forward(w, inputs, own)
    p = np.exp(np.clip(logits, -40, 40, out=logits))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(p)), targets.ravel()] -= 1
    p *= (counts.ravel()[:, None] / max(1, counts.sum())).astype(p.dtype)
    g: Weights = {}
    g["direct"] = _sums(inputs[:, BACK:].ravel(), p, CLASSES + 2)[: CLASSES + 1]
    g["out"] = outer(s["h"], p)
    dh = times(p, w["out"].T) * (1 - s["h"] ** 2)
    g["mix"] = outer(s["seen"].reshape(-1, SIZE), dh)
    dseen = times(dh, w["mix"].T).reshape(n, STEP, SIZE)
    share = s["a"] / s["total"]
    seeable = (inputs != NONE)[..., None]
    dv = np.matmul(share.transpose(0, 2, 1), dseen) * seeable
    dshare = np.matmul(dseen, s["v"][..., :SIZE].transpose(0, 2, 1))
    share *= seeable.transpose(0, 2, 1)
    da = share * (dshare - (dshare * share).sum(axis=2, keepdims=True)) * p.dtype.type(SIZE**-0.5)
    dq = (np.matmul(da, s["k"]) * (1 - s["q"] ** 2)).reshape(-1, SIZE)
    dk = (np.matmul(da.transpose(0, 2, 1), s["q"]) * (1 - s["k"] ** 2)).reshape(-1, SIZE)
    dv = dv.reshape(-1, SIZE)
    g["query"], g["key"], g["value"] = outer(s["last"], dq), outer(s["rows"], dk), outer(s["rows"], dv)
    dx = (times(dk, w["key"].T) + times(dv, w["value"].T)).reshape(n, WIDTH, SIZE)
    dx[:, BACK:] += (dh + times(dq, w["query"].T)).reshape(n, STEP, SIZE)
    g["place"] = dx.sum(axis=0)
    dx = dx.reshape(-1, SIZE)
    g["embed"] = _sums(inputs.ravel(), dx, CLASSES + 2)[: CLASSES + 1]
    g["own"] = _sums(own.ravel(), dx, SLOTS)
    return g


class Adam:
    """All weights as one row of numbers; ``w`` are views of it."""

    def __init__(self, weights: Weights, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.row = flat(weights)
        self.w = unflat(self.row)
        self.m, self.v = np.zeros_like(self.row), np.zeros_like(self.row)

    def step(self, g: Weights) -> None:
        self.t += 1
        row = flat(g)
        self.m *= 0.9
        self.m += 0.1 * row
        self.v *= 0.99
        row *= row
        row *= 0.01
        self.v += row
        np.divide(self.v, 1 - 0.99**self.t, out=row)
        np.sqrt(row, out=row)
        row += 1e-8
        change = self.m / (1 - 0.9**self.t)
        change *= self.rate
        change /= row
        self.row -= change


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences laid end to end: each window's first target, and the begin
    and the end of its sequence."""
    sizes = sizes.astype(np.int64)
    number = -(-sizes // STEP)
    begin = np.cumsum(sizes) - sizes
    which = ragged(np.zeros(len(sizes), np.int64), number)
    return np.repeat(begin, number) + which * STEP, np.repeat(begin, number), np.repeat(begin + sizes, number)


def window_batches(ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray):
    """Batches of (inputs, slots, targets, places, scored) of the windows over
    sequences laid end to end. A target's input is the subword before it, or
    the start symbol."""
    own = slots(ids)
    first, begin, end = windows(sizes)
    for k in range(0, len(first), BATCH):
        a, b, z = first[k : k + BATCH, None], begin[k : k + BATCH, None], end[k : k + BATCH, None]
        at = a - BACK + np.arange(WIDTH)  # the targets whose inputs these are
        before = np.clip(at, b, z - 1) - 1  # behind the end: no earlier place sees it
        inputs = classes.take(before, mode="wrap")
        inputs[at == b] = START
        inputs[at < b] = NONE
        there = at[:, BACK:]
        scored = there < z
        there = np.minimum(there, z - 1)
        yield inputs, np.where(at > b, own.take(before, mode="wrap"), 0), classes[there], there, scored


def train(w: Weights, ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, adam: Adam | None = None) -> Adam:
    """One pass over the sequences."""
    adam = adam or Adam(w)
    for inputs, own, targets, _, scored in window_batches(ids, classes, sizes):
        adam.step(gradient(adam.w, inputs, own, targets, scored))
    return adam


def score(w: Weights, ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of every class, each scored once, and at every
    place that of the classes of ``group``."""
    out, whole = np.zeros(len(classes), np.float32), np.zeros(len(classes), np.float32)
    for inputs, own, targets, at, scored in window_batches(ids, classes, sizes):
        said, all_ = log_probs(w, inputs, own, targets, group)
        out[at[scored]], whole[at[scored]] = said[scored], all_[scored]
    return out, whole
