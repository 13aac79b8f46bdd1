"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are the VOCAB most frequent words (the end of a text among them) and, for all other words, TAILS shapes (first
letter, final punctuation). The output is a softmax over classes; a class is a run of words of about equal frequency,
with a softmax over its words, or one shape. Documents are dealt to lanes that run in step; a lane's state is carried
from window to window and set to zero where a document begins, so that a document's log-likelihood is complete however
long it is. Training is by truncated backpropagation over windows, with Adagrad. Windows are cut from one flat array of
symbols, so that memory follows the tokens and not the longest document; where few lanes are left, windows are longer.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

HIDDEN, EMBED, CLASSES = 16, 16, 64
TRAIN_LANES, TRAIN_WINDOW, CLIP = 384, 16, 4.0
#: The learning rate falls from RATE by the share FALL over a call of train, which makes about STEPS steps: of few
#: documents the lanes are fewer, so that a small corpus is not learned in a handful of large steps.
RATE, FALL, STEPS = 0.2, 0.9, 320
#: Adagrad's sums at the start. The output biases are the corpus's own counts, hence right from the start: they stay.
START = {"E": 1e-4, "W": 1e-4, "U": 1e-4, "b": 1e-4, "C": 3e-3, "O": 3e-3, "cb": 1e12, "ob": 1e12}
SCORE_LANES, SCORE_WINDOW = 512, 32
#: Most steps of a window when few lanes are left.
TRAIN_LONGEST, SCORE_LONGEST = 64, 512
f32 = np.float32


def _shape_tables() -> tuple[np.ndarray, np.ndarray]:
    first = np.full(256, 28, dtype=np.int32)
    first[0x80:] = 27
    first[ord("0") : ord("9") + 1] = 26
    for k in range(26):
        first[ord("a") + k] = first[ord("A") + k] = k
    last = np.zeros(256, dtype=np.int32)
    last[[ord(c) for c in ".,;:!?'\")]}"]] = 1
    return first, last


FIRST, LAST = _shape_tables()
TAILS = 58


def shapes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shape of words by their first and last bytes."""
    return FIRST[first] * 2 + LAST[last]


@dataclass
class Layout:
    """How VOCAB words fall into classes, by their counts in falling order."""

    counts: np.ndarray
    tail_counts: np.ndarray
    first: np.ndarray = field(init=False)  # of each class, its first word; one more at the end
    of_word: np.ndarray = field(init=False)

    def __post_init__(self):
        root = np.sqrt(np.maximum(self.counts, 0.5))
        share = (np.cumsum(root) - root / 2) / root.sum()
        self.of_word = np.minimum((share * CLASSES).astype(np.int32), CLASSES - 1)
        _, self.of_word = np.unique(self.of_word, return_inverse=True)
        self.first = np.concatenate((np.flatnonzero(np.diff(self.of_word, prepend=-1)), [len(self.counts)]))

    @property
    def vocab(self) -> int:
        return len(self.counts)

    @property
    def word_classes(self) -> int:
        return len(self.first) - 1

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        """The class of each symbol: a word's, or one for each shape after those."""
        return np.where(symbols < self.vocab, self.of_word[np.minimum(symbols, self.vocab - 1)], self.word_classes + symbols - self.vocab)


SHAPES = ("E", "W", "U", "b", "C", "cb", "O", "ob")


def initial(layout: Layout, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights that start as the unigram model: output weights 0, biases from the counts."""
    rng = np.random.default_rng(seed)
    h, e = HIDDEN, EMBED
    mass = np.add.reduceat(layout.counts + 0.5, layout.first[:-1])
    every = np.concatenate((mass, layout.tail_counts + 0.5))
    b = np.zeros(3 * h)
    b[:h] = 1.0  # gates begin by keeping the state
    weights = {
        "E": rng.normal(0, 0.5, (layout.vocab + TAILS, e)), "W": rng.normal(0, e**-0.5, (e, 3 * h)), "U": rng.normal(0, 0.5 * h**-0.5, (h, 3 * h)), "b": b,
        "C": np.zeros((h, layout.word_classes + TAILS)), "cb": np.log(every / every.sum()), "O": np.zeros((layout.vocab, h)), "ob": np.log((layout.counts + 0.5) / mass[layout.of_word]),
    }
    return {k: v.astype(f32) for k, v in weights.items()}


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in SHAPES:
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).astype(f32)
        at += n
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, f32(80), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Lanes:
    """Documents end to end in lanes of about equal length, the longest lane first, one lane after another in flat arrays.

    A document is its symbols with the end last. ``start`` is where each document lies in the flat arrays.
    """

    def __init__(self, docs: list[np.ndarray], width: int):
        sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
        width = max(1, min(width, len(docs)))
        load = [(0, k) for k in range(width)]
        lane = np.zeros(len(docs), dtype=np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            used, k = heapq.heappop(load)
            lane[i] = k
            heapq.heappush(load, (used + int(sizes[i]), k))
        used = np.zeros(width, dtype=np.int64)
        for n, k in load:
            used[k] = n
        # inside a lane documents keep their order, so that long and short ones mix
        by_lane = np.argsort(lane, kind="stable")
        before = np.concatenate(([0], np.cumsum(sizes[by_lane])[:-1])) if len(docs) else sizes
        within = np.empty(len(docs), dtype=np.int64)
        within[by_lane] = before - np.repeat(np.concatenate(([0], np.cumsum(used)[:-1])), np.bincount(lane, minlength=width))
        order = np.argsort(-used, kind="stable")
        self.lengths = used[order]
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        at = np.empty(width, dtype=np.int64)
        at[order] = self.offsets
        self.start, self.sizes = at[lane] + within, sizes
        self.symbols = np.empty(int(sizes.sum()), dtype=np.int32)
        for d, k in zip(docs, self.start.tolist(), strict=True):
            self.symbols[k : k + len(d)] = d
        self.begins = np.zeros(len(self.symbols), dtype=bool)
        self.begins[self.start] = True

    def windows(self, steps: int, most: int):
        """(inputs, targets, where a document begins, which targets there are, their places in the flat arrays), each [steps, lanes still running]."""
        a, longest, full = 0, int(self.lengths[0]), steps * len(self.lengths)
        while a < longest:
            width = int(np.searchsorted(-self.lengths, -a, side="left"))
            b = min(a + max(steps, min(most, full // width)), longest)
            t = np.arange(a, b)[:, None]
            live = t < self.lengths[:width]
            at = self.offsets[:width] + np.minimum(t, self.lengths[:width] - 1)
            begins = self.begins[at]
            x = self.symbols[at - 1]
            x[begins] = 0
            yield x, self.symbols[at], begins, live, at
            a = b


def _kept(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return h * ~begins if begins.any() else h


def _forward(xp: np.ndarray, begins: np.ndarray, h: np.ndarray, ut: np.ndarray) -> tuple[np.ndarray, ...]:
    """States after each step, those before it, gates, new states and their inner products: all [steps, values, lanes]."""
    n, (steps, _, width) = HIDDEN, xp.shape
    states, before, un, new = (np.empty((steps, n, width), dtype=f32) for _ in range(4))
    for t in range(steps):
        h = before[t] = _kept(h, begins[t])
        g = ut @ h
        gates = xp[t, : 2 * n]
        gates += g[: 2 * n]
        sigmoid(gates)
        un[t] = g[2 * n :]
        c = np.multiply(gates[n:], un[t], out=new[t])
        c += xp[t, 2 * n :]
        np.tanh(c, out=c)
        out = np.subtract(h, c, out=states[t])
        out *= gates[:n]
        out += c
        h = out
    return states, before, xp[:, :n], xp[:, n : 2 * n], un, new


def _advance(xp: np.ndarray, begins: np.ndarray, h: np.ndarray, ut: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The forward pass alone; fills states [steps, values, lanes]."""
    n = HIDDEN
    for t in range(len(xp)):
        h = _kept(h, begins[t])
        x, g = xp[t], ut @ h
        gates = x[: 2 * n]
        gates += g[: 2 * n]
        sigmoid(gates)
        c = np.multiply(gates[n:], g[2 * n :], out=g[2 * n :])
        c += x[2 * n :]
        np.tanh(c, out=c)
        h = np.subtract(h, c, out=states[t])
        h *= gates[:n]
        h += c
    return h


def _projected(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The inputs' projections, [steps, 3 hidden, lanes]."""
    return np.ascontiguousarray(table[x].transpose(0, 2, 1))


def _bounded(*weights: np.ndarray) -> bool:
    """Whether no product of a state (within -1..1) and the bias's 1 with these [values, columns] can overflow exp."""
    return max(float(np.abs(w).sum(axis=0).max()) for w in weights) < 80


def _exponentials(logits: np.ndarray, bounded: bool) -> np.ndarray:
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    return np.exp(logits, out=logits)


def _picked_log(s: np.ndarray, weights: np.ndarray, column: np.ndarray, bounded: bool) -> np.ndarray:
    """The log-softmax of s @ weights, each row at its column, in blocks of rows that stay in a processor's cache."""
    n, k = len(s), weights.shape[1]
    rows = max(64, BLOCK_VALUES // k)
    out, held = np.empty(n, dtype=f32), np.empty((min(rows, n), k), dtype=f32)
    at = np.arange(min(rows, n))
    for a in range(0, n, rows):
        b = min(a + rows, n)
        logits = np.matmul(s[a:b], weights, out=held[: b - a])
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        picked = logits[at[: b - a], column[a:b]]
        np.exp(logits, out=logits)
        out[a:b] = picked - np.log(logits @ ONES[:k])
    return out


BLOCK_VALUES = 200_000
ONES = np.ones(1 << 16, dtype=f32)


def _by_class(layout: Layout, y: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The places of targets that are one of several words of a class, by class; (from, to, first word, last) of each class."""
    words = np.flatnonzero(y < layout.vocab)
    c = classes[words]
    order = words[np.argsort(c.astype(np.int16) if layout.word_classes < 1 << 15 else c, kind="stable")]
    bounds = np.searchsorted(classes[order], np.arange(layout.word_classes + 1)).tolist()
    first = layout.first.tolist()
    return order, [(bounds[k], bounds[k + 1], first[k], first[k + 1]) for k in range(layout.word_classes) if bounds[k] < bounds[k + 1] and first[k + 1] - first[k] > 1]


def _with_one(states: np.ndarray, live: np.ndarray) -> np.ndarray:
    """[targets, hidden + 1] of states [steps, hidden, lanes]: a row for each target there is, 1 in the last column for the biases."""
    s = np.ones((states.shape[0], states.shape[2], HIDDEN + 1), dtype=f32)
    s[:, :, :HIDDEN] = states.transpose(0, 2, 1)
    s = s.reshape(-1, HIDDEN + 1)
    return s if live.all() else s[live.ravel()]


def score(docs: list[np.ndarray], weights: dict[str, np.ndarray], layout: Layout) -> np.ndarray:
    """Natural log-probability of each document's symbols (a shape's word is not counted in)."""
    if not docs:
        return np.zeros(0)
    lanes = Lanes(docs, SCORE_LANES)
    table, ut = weights["E"] @ weights["W"] + weights["b"], np.ascontiguousarray(weights["U"].T)
    to_class, to_word = np.vstack((weights["C"], weights["cb"])), np.ascontiguousarray(np.column_stack((weights["O"], weights["ob"])).T)
    bounded = _bounded(to_class, to_word)
    h, logs = np.zeros((HIDDEN, len(lanes.lengths)), dtype=f32), np.zeros(len(lanes.symbols), dtype=f32)
    for x, y, begins, live, at in lanes.windows(SCORE_WINDOW, SCORE_LONGEST):
        states = np.empty((len(x), HIDDEN, x.shape[1]), dtype=f32)
        h = _advance(_projected(table, x), begins, h[:, : x.shape[1]], ut, states)
        s, t = _with_one(states, live), y[live]
        classes = layout.class_of(t)
        out = _picked_log(s, to_class, classes, bounded)
        order, groups = _by_class(layout, t, classes)
        so, to = s[order], t[order]
        inner = np.zeros(len(order), dtype=f32)
        for a, b, first, last in groups:
            inner[a:b] = _picked_log(so[a:b], to_word[:, first:last], to[a:b] - first, bounded)
        out[order] += inner
        logs[at[live]] = out
    by_place = np.argsort(lanes.start, kind="stable")
    sums = np.empty(len(docs))
    sums[by_place] = np.add.reduceat(logs, lanes.start[by_place], dtype=np.float64)
    return sums


def train(docs: list[np.ndarray], weights: dict[str, np.ndarray], layout: Layout, rate: float = RATE, memory: dict | None = None, fall: float = FALL) -> tuple[int, float]:
    """Change weights by one pass over the documents, learning from every window, at a rate that falls to (1 - fall) of it.

    memory holds Adagrad's sums between calls. Returns the targets learned from and their summed log-probability.
    """
    if not docs:
        return 0, 0.0
    memory = {} if memory is None else memory
    for k in SHAPES:
        memory.setdefault(k, np.full(weights[k].shape, START[k], dtype=f32))
    n, e, w, u, bias = HIDDEN, weights["E"], weights["W"], weights["U"], weights["b"]
    # output weights with their biases as a last row or column
    to_class, class_memory = (np.vstack((x["C"], x["cb"])) for x in (weights, memory))
    to_word, word_memory = (np.column_stack((x["O"], x["ob"])) for x in (weights, memory))
    total_targets = sum(map(len, docs))
    lanes = Lanes(docs, min(TRAIN_LANES, max(8, total_targets // (TRAIN_WINDOW * STEPS))))
    h = np.zeros((n, len(lanes.lengths)), dtype=f32)
    learned, likelihood, now = 0, 0.0, f32(rate)

    def step(values: np.ndarray, m: np.ndarray, g: np.ndarray) -> None:
        m += g * g
        g *= now
        g /= np.sqrt(m)
        values -= g

    for x, y, begins, live, _ in lanes.windows(TRAIN_WINDOW, TRAIN_LONGEST):
        steps, width = x.shape
        now = f32(rate * (1 - fall * learned / total_targets))
        xp = _projected(e @ w + bias, x)
        states, before, z, r, un, new = _forward(xp, begins, h[:, :width], np.ascontiguousarray(u.T))
        h = states[-1]
        s, t = _with_one(states, live), y[live]
        scale = f32(1 / len(t))
        classes = layout.class_of(t)
        bounded = _bounded(to_class, to_word.T)

        ds, dclass = np.empty((len(t), n), dtype=f32), np.zeros_like(to_class)
        block = max(64, BLOCK_VALUES // to_class.shape[1])
        for a in range(0, len(t), block):
            own, c = s[a : a + block], classes[a : a + block]
            d = _exponentials(own @ to_class, bounded)
            rows = np.arange(len(own))
            total = d @ ONES[: d.shape[1]]
            likelihood += float(np.log(d[rows, c] / total + f32(1e-30)).sum(dtype=np.float64))
            d *= (scale / total)[:, None]
            d[rows, c] -= scale
            np.matmul(d, to_class[:n].T, out=ds[a : a + block])
            dclass += own.T @ d
        order, groups = _by_class(layout, t, classes)
        so, to = s[order], t[order]
        dso, dword = np.zeros((len(order), n), dtype=f32), np.zeros_like(to_word)
        for a, b, first, last in groups:
            d = _exponentials(so[a:b] @ to_word[first:last].T, bounded)
            rows, c = np.arange(b - a), to[a:b] - first
            total = d @ ONES[: last - first]
            likelihood += float(np.log(d[rows, c] / total + f32(1e-30)).sum(dtype=np.float64))
            d *= (scale / total)[:, None]
            d[rows, c] -= scale
            np.matmul(d, to_word[first:last, :n], out=dso[a:b])
            np.matmul(d.T, so[a:b], out=dword[first:last])
        ds[order] += dso
        step(to_class, class_memory, dclass)
        step(to_word, word_memory, dword)
        learned += len(t)

        every = ds
        if len(t) < live.size:
            every = np.zeros((live.size, n), dtype=f32)
            every[live.ravel()] = ds
        dstates = np.ascontiguousarray(every.reshape(steps, width, n).transpose(0, 2, 1))
        through_new, through_z, through_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), un * r * (1 - r)
        dx, inner = np.empty((steps, 3 * n, width), dtype=f32), np.empty((steps, 3 * n, width), dtype=f32)
        dh = np.zeros((n, width), dtype=f32)
        for j in range(steps - 1, -1, -1):
            dh += dstates[j]
            dnew = np.multiply(dh, through_new[j], out=dx[j, 2 * n :])
            np.multiply(dh, through_z[j], out=inner[j, :n])
            np.multiply(dnew, through_r[j], out=inner[j, n : 2 * n])
            np.multiply(dnew, r[j], out=inner[j, 2 * n :])
            dh *= z[j]
            dh += u @ inner[j]
            dh = _kept(dh, begins[j])
        dx[:, : 2 * n] = inner[:, : 2 * n]
        flat = np.ascontiguousarray(dx.transpose(0, 2, 1)).reshape(-1, 3 * n)
        du = before.transpose(1, 0, 2).reshape(n, -1) @ inner.transpose(0, 2, 1).reshape(-1, 3 * n)
        symbols = x.ravel()
        order = np.argsort(symbols.astype(np.int16) if len(e) < 1 << 15 else symbols, kind="stable")
        own = symbols[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        rows = own[first]
        de = np.add.reduceat(flat[order], first, axis=0)
        size = float(np.sqrt((flat * flat).sum() + (du * du).sum()))
        cut = f32(min(1.0, CLIP / max(size, 1e-9)))
        emb, m = e[rows], memory["E"][rows]
        step(w, memory["W"], emb.T @ de * cut)
        step(emb, m, de @ w.T * cut)
        e[rows], memory["E"][rows] = emb, m
        step(u, memory["U"], du * cut)
        step(bias, memory["b"], de.sum(axis=0) * cut)
    for x, out, names in ((to_class, weights, ("C", "cb")), (class_memory, memory, ("C", "cb")), (to_word.T, weights, ("O", "ob")), (word_memory.T, memory, ("O", "ob"))):
        out[names[0]][...], out[names[1]][...] = (x[:-1] if names[0] == "C" else x[:-1].T), x[-1]
    return learned, likelihood
