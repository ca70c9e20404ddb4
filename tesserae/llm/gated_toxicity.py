"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs. A word enters as two vectors side by side: that of its hashed self and the mean of those of its
hashed character n-grams, its ends included, so that an unseen form of a known root is near the
known ones. ASCII capitals are lowered and ASCII marks separate words.

Network. Two gated recurrent layers read a window of words, one in each direction; attention over the
window's states gives one logit for each window. Windows of WINDOW words start every STRIDE words, so
that they overlap and cover the whole text. A text is toxic if any window is: its chance is 1 less the product of
the windows' chances not to be (noisy or), and the loss of a labelled text runs through that back to every
window, since labels name no place. A small logistic on the text's totals, fitted on a quarter of the learning rows that the
network did not see, makes the final score.

Learning uses at most `sample` labelled rows, half of each class where there are so many, chosen by hash, and of
those texts of up to `longest` bytes; they are learnt from on the driver. Scoring reads every word of every text
in Arrow batches where Spark put the rows, with no exchange; the model is a fixed number of bytes.

Defined cases: a null or empty text, or one without words, has a single window without words; null keys count as '' in
the split; of several labels of a key the least counts; rows that repeat are scored alike; without labels, or
with one class only, the score is that class's rate (0.5 without labels); an empty table gives an empty
result; only the key of the input is kept, so no name clashes; texts of any length are scored whole, windows in
blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_bucket, pieces, quoted

WINDOW, STRIDE = 40, 30
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 8, 16
WORD_ROWS, CHAR_ROWS, GRAMS = 1 << 14, 1 << 15, (3, 5, 7)
SAMPLE, LONGEST, EPOCHS, STEPS, BATCH = 4_000, 200_000, 4, 200, 512
BLOCK, CACHED, PIECE = 1024, 100_000, 1 << 20

_LOWER = bytearray(range(256))
for _c in range(128):
    _LOWER[_c] = _c + 32 if 65 <= _c <= 90 else _c if 97 <= _c <= 122 or 48 <= _c <= 57 else 32
_LOWER = bytes(_LOWER)


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


# --- inputs --------------------------------------------------------------------------------


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, row) of every character n-gram of the words, ordered by word."""
    raw = np.frombuffer(b"\n" + b"\n".join(words) + b"\n", np.uint8)
    marks = np.cumsum(raw == 10, dtype=np.int32)
    owner, row = [], []
    for n in GRAMS:
        if raw.size < n:
            continue
        at = np.flatnonzero(marks[n - 2 : raw.size - 1] == marks[: raw.size - n + 1])  # no mark inside, but at an end
        h = np.full(at.size, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + raw[at + j]
        owner.append((marks[at] - 1).astype(np.int32))
        row.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int32) % np.int32(CHAR_ROWS))
    owner, row = np.concatenate(owner), np.concatenate(row)
    order = np.argsort(owner, kind="stable")
    return owner[order], row[order]


@dataclass
class Words:
    """Distinct words by their rows in the two input tables."""

    word_row: np.ndarray
    gram_word: np.ndarray
    gram_row: np.ndarray

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        rows = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORD_ROWS
        return cls(rows, *char_grams(words))

    def share(self) -> np.ndarray:
        """The weight of each gram of a word: they sum to 1."""
        return (1.0 / np.maximum(np.bincount(self.gram_word, minlength=self.word_row.size), 1)).astype(np.float32)

    def vectors(self, model: Model) -> np.ndarray:
        chars = summed(model.char, self.gram_word, self.word_row.size, self.gram_row)
        return np.concatenate([model.word[self.word_row], chars * self.share()[:, None]], axis=1)

    def subset(self, chosen: np.ndarray) -> Words:
        first = np.searchsorted(self.gram_word, chosen)
        word, at = spread(first, np.searchsorted(self.gram_word, chosen, side="right") - first)
        return Words(self.word_row[chosen], word, self.gram_row[at])


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): first[i], first[i] + 1, ... size[i] places for each i."""
    owner = np.repeat(np.arange(size.size), size)
    return owner, np.arange(owner.size) - (np.cumsum(size) - size)[owner] + first[owner]


FEW = 32


def summed(values: np.ndarray, group: np.ndarray, groups: int, rows: np.ndarray | None = None) -> np.ndarray:
    """Sums of values[rows] by group, where group is in order: the first FEW rows of all groups are added one by one for
    all groups at once, what larger groups have beyond them in a second way."""
    out = np.zeros((groups, *values.shape[1:]), values.dtype)
    if not group.size:
        return out
    rows = np.arange(len(values)) if rows is None else rows
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, group.size))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(FEW), side="left")
    total = values[rows[first]]
    for j in range(1, min(FEW, int(size[0]))):
        total[: live[j]] += values[rows[first[: live[j]] + j]]
    out[group[first]] = total
    if size[0] > FEW:
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(group.size) - np.repeat(begin, np.diff(np.append(begin, group.size)))
        rest = np.flatnonzero(place >= FEW)
        cut = np.flatnonzero(np.concatenate([[True], group[rest[1:]] != group[rest[:-1]]]))
        out[group[rest[cut]]] += np.add.reduceat(values[rows[rest]], cut, axis=0)
    return out


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of every window; start counts in the words of all texts in a row. A text has
    one window at least."""
    first = np.cumsum(sizes) - sizes
    number = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(sizes.size), number)
    at = (np.arange(text.size) - (np.cumsum(number) - number)[text]) * STRIDE
    return text, first[text] + at, np.minimum(WINDOW, sizes[text] - at)


def laid_out(ids: np.ndarray, start: np.ndarray, length: np.ndarray, pad: int) -> np.ndarray:
    """(windows, WINDOW) word numbers, padded at the end."""
    column = np.arange(WINDOW)
    at = np.minimum(start[:, None] + column, max(ids.size - 1, 0))
    return np.where(column < length[:, None], ids[at] if ids.size else pad, pad)


# --- network -------------------------------------------------------------------------------

ROWS = 128  # of a product at a time: larger ones wake all threads of the linear algebra library, which then spin


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), b.shape[1]), np.float32)
    for i in range(0, len(a), ROWS):
        np.matmul(a[i : i + ROWS], b, out=out[i : i + ROWS])
    return out


def outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a transposed times b."""
    return sum((a[i : i + ROWS].T @ b[i : i + ROWS] for i in range(0, len(a), ROWS)), np.zeros((a.shape[1], b.shape[1]), np.float32))


@dataclass
class Model:
    word: np.ndarray  # (WORD_ROWS, WORD_SIZE)
    char: np.ndarray  # (CHAR_ROWS, CHAR_SIZE)
    enter: np.ndarray  # (inputs, 2 * 3 * HIDDEN): direction, then reset, update, candidate
    shift: np.ndarray
    turn: np.ndarray  # (3, 2, HIDDEN, HIDDEN): reset, update, candidate, then direction
    heed: np.ndarray  # (2, HIDDEN)
    read: np.ndarray
    base: np.ndarray  # (1,)
    final: np.ndarray  # weights of totals(), the last alone

    @classmethod
    def fresh(cls, seed: int, rate: float) -> Model:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs = WORD_SIZE + CHAR_SIZE
        return cls(normal(0.1, WORD_ROWS, WORD_SIZE), normal(0.3, CHAR_ROWS, CHAR_SIZE), normal(inputs**-0.5, inputs, 6 * HIDDEN), np.zeros(6 * HIDDEN, np.float32), normal(HIDDEN**-0.5, 3, 2, HIDDEN, HIDDEN),
                   normal(0.5, 2, HIDDEN), normal(0.5, 2, HIDDEN), np.full(1, np.log(rate / (1 - rate)) - 2, np.float32), np.array([1.0, 0, 0, 0, 0]))

    def entries(self, words: Words) -> np.ndarray:
        """(3, 2, words + 1, HIDDEN): what each word brings to each gate and direction; the last row is the pad, 0,
        which leaves a state of 0 at 0."""
        table = product(words.vectors(self), self.enter) + self.shift
        out = np.zeros((3, 2, len(table) + 1, HIDDEN), np.float32)
        out[:, :, :-1] = table.reshape(-1, 2, 3, HIDDEN).transpose(2, 1, 0, 3)
        return out

    def states(self, table: np.ndarray, ids: np.ndarray, kept: list | None = None) -> np.ndarray:
        """(WINDOW, 2, windows, HIDDEN): states in reading order of each direction."""
        n = len(ids)
        out = np.empty((WINDOW, 2, n, HIDDEN), np.float32)
        h, brought, half = np.zeros((2, n, HIDDEN), np.float32), np.empty((3, 2, n, HIDDEN), np.float32), np.float32(0.5)
        order = np.ascontiguousarray(ids.T)
        for t in range(WINDOW):
            for gate in range(3):
                np.take(table[gate, 0], order[t], axis=0, out=brought[gate, 0], mode="clip")
                np.take(table[gate, 1], order[WINDOW - 1 - t], axis=0, out=brought[gate, 1], mode="clip")
            turned = h @ self.turn
            gates = brought[:2] + turned[:2]
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            new = gates[0] * turned[2]
            new += brought[2]
            np.tanh(new, out=new)
            if kept is not None:
                kept.append((h, gates, new, turned[2]))
            h = np.add(new, gates[1] * (h - new), out=out[t])
        return out

    def logits(self, table: np.ndarray, ids: np.ndarray, pad: int, kept: dict | None = None) -> np.ndarray:
        steps: list | None = None if kept is None else []
        states = self.states(table, ids, steps)
        both = states @ np.stack([self.heed, self.read], axis=2)  # (WINDOW, 2, windows, 2)
        seen = both[:, 0] + both[::-1, 1]
        empty = ids.T == pad
        heed = np.where(empty, np.float32(-1e9), seen[..., 0])
        alpha = np.exp(heed - heed.max(axis=0))
        alpha[empty] = 0
        alpha /= np.maximum(alpha.sum(axis=0), np.float32(1e-9))
        if kept is not None:
            kept.update(steps=steps, states=states, alpha=alpha, value=seen[..., 1])
        return (alpha * seen[..., 1]).sum(axis=0) + self.base[0]

    def gradients(self, words: Words, ids: np.ndarray, kept: dict, slope: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss by every table, where slope is the loss by each window's logit."""
        alpha, states = kept["alpha"], kept["states"]
        value = alpha * slope
        heed = value * kept["value"]
        heed -= alpha * heed.sum(axis=0)
        both = np.stack([heed, value], axis=-1)  # by the two sums of each word's states
        both = np.stack([both, both[::-1]], axis=1)  # (WINDOW, 2, windows, 2)
        by_state = both @ np.stack([self.heed, self.read], axis=1)
        by_ends = (states.transpose(0, 1, 3, 2) @ both).sum(axis=0)
        by_turn, back = np.zeros_like(self.turn), np.zeros_like(states[0])
        by_entry = np.empty((WINDOW, 3, 2, len(ids), HIDDEN), np.float32)
        turn_back = self.turn.transpose(0, 1, 3, 2)
        for t in range(WINDOW - 1, -1, -1):
            h, (reset, update), new, turned = kept["steps"][t]
            back += by_state[t]
            by_new = back * (1 - update) * (1 - new * new)
            step = by_entry[t]
            step[0] = by_new * turned * reset * (1 - reset)
            step[1] = back * (h - new) * update * (1 - update)
            step[2] = by_new
            through = step.copy()
            through[2] *= reset
            by_turn += h.transpose(0, 2, 1) @ through
            back = back * update + (through @ turn_back).sum(axis=0)
        pad = words.word_row.size
        by_word = np.empty((pad, 2, 3, HIDDEN), np.float32)
        for side, read in enumerate((ids.T, ids.T[::-1])):
            flat = read.reshape(-1)
            order = np.argsort(flat, kind="stable")
            order = order[: np.searchsorted(flat[order], pad)]
            for gate in range(3):
                by_word[:, side, gate] = summed(by_entry[:, gate, side].reshape(-1, HIDDEN), flat[order], pad, order)
        by_word = by_word.reshape(pad, -1)
        by_input = product(by_word, self.enter.T)
        by_gram = by_input[:, WORD_SIZE:] * words.share()[:, None]
        return {"turn": by_turn, "heed": by_ends[..., 0], "read": by_ends[..., 1], "base": slope.sum(keepdims=True), "enter": outer(words.vectors(self), by_word), "shift": by_word.sum(axis=0),
                "word": by_input[:, :WORD_SIZE], "char": by_gram}  # char: by every gram of a word


# --- texts ---------------------------------------------------------------------------------


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def totals(logit: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: the logit of the noisy or, the greatest logit, the logarithms of the mean of the windows' weight and of their number, 1."""
    weight = np.bincount(text, softplus(logit), texts)
    number = np.bincount(text, minlength=texts)
    most = np.full(texts, -np.inf)
    np.maximum.at(most, text, logit)
    any_of = np.where(weight > 30, weight, np.log(np.expm1(np.minimum(weight, 30)) + 1e-12))
    return np.stack([np.clip(any_of, -20, 20), np.clip(most, -20, 20), np.log(weight / number + 1e-9), np.log(number), np.ones(texts)], axis=1)


def final_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hold: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's method, held to those that return the noisy or."""
    prior = np.array([1.0, 0, 0, 0, 0])
    stiff = hold * np.array([1, 1, 1, 1, 0.01])
    w = prior.copy()
    loss = lambda v: float((weight * (softplus(x @ v) - y * (x @ v))).sum() + (stiff * (v - prior) ** 2).sum() / 2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + stiff * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(stiff), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w


class Numbers(dict):
    """Numbers words in the order of their first lookup."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(known: Numbers, texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts in a row, words of each text)."""
    parts = [np.fromiter(map(known.__getitem__, words), np.int32, len(words)) for words in texts]
    return np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)


def texts_of(ids: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The word numbers of the chosen texts in a row."""
    last = np.cumsum(sizes)
    return np.concatenate([np.zeros(0, ids.dtype), *(ids[last[i] - sizes[i] : last[i]] for i in chosen)])


def block_logits(model: Model, table: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, logit) of every window of the texts, in blocks of windows."""
    text, start, length = windows(sizes)
    pad = table.shape[2] - 1
    out = [model.logits(table, laid_out(ids, start[a : a + BLOCK], length[a : a + BLOCK], pad), pad) for a in range(0, text.size, BLOCK)]
    return text, np.concatenate(out or [np.zeros(0)]).astype(np.float64)


def doc_slopes(logit: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted loss of the noisy or and its slope by each window's logit."""
    total = np.bincount(text, softplus(logit), y.size)
    chance = -np.expm1(-total)
    loss = np.where(y > 0, -np.log(np.maximum(chance, 1e-12)), total)
    factor = np.where(y > 0, -np.exp(-total) / np.maximum(chance, 1e-6), 1.0) * weight
    return float((loss * weight).sum()), (factor[text] / (1 + np.exp(-logit))).astype(np.float32)


def leaning(words: Words, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of the two input tables: how many more toxic texts than its share hold it, in standard
    deviations and a bit."""
    found = [np.zeros((2, n)) for n in (WORD_ROWS, CHAR_ROWS)]
    first_gram, last = np.searchsorted(words.gram_word, np.arange(words.word_row.size + 1)), np.cumsum(sizes)
    for i, toxic in enumerate(y):
        word = np.unique(ids[last[i] - sizes[i] : last[i]])
        _, at = spread(first_gram[word], first_gram[word + 1] - first_gram[word])
        for count, row in zip(found, (words.word_row[word], words.gram_row[at])):
            row = np.unique(row)
            count[0, row] += 1
            count[1, row] += toxic
    rate = float(y.mean())
    return tuple(((n1 - n * rate) / np.sqrt(n * rate * (1 - rate) + 1)).astype(np.float32) for n, n1 in found)


def train(words: Words, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.01, dropped: float = 0.2) -> Model:
    """Adam for the network, Adagrad for the rows of the input tables that a batch touches. Batches hold whole
    texts, of about BATCH windows; few texts are gone through more often, for STEPS batches at least. A share of the
    words is read as pads in each batch."""
    model = Model.fresh(seed, min(max(float(np.average(y, weights=weight)), 0.01), 0.99))
    rng = np.random.default_rng(seed)
    names = ("enter", "shift", "turn", "heed", "read", "base")
    first, second = ({n: np.zeros_like(getattr(model, n)) for n in names} for _ in range(2))
    seen = {"word": np.zeros(WORD_ROWS, np.float32), "char": np.zeros(CHAR_ROWS, np.float32)}
    usual = dict.fromkeys(seen, 0.0)
    model.word[:, 0], model.char[:, 0] = (0.1 * x for x in leaning(words, ids, sizes, y))  # the first number of an input starts there
    number = np.bincount(windows(sizes)[0], minlength=sizes.size)
    done, epochs = 0, max(epochs, -(-STEPS // max(1, int(number.sum()) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(sizes.size)
        cuts = np.flatnonzero(np.diff(np.cumsum(number[order]) // BATCH)) + 1
        pace = rate * (1 - epoch / epochs) ** 0.5
        for rows in np.split(order, cuts):
            used, local = np.unique(texts_of(ids, sizes, rows), return_inverse=True)
            part = words.subset(used)
            text, start, length = windows(sizes[rows])
            pad, table = used.size, model.entries(part)
            laid = laid_out(np.where(rng.random(local.size) < dropped, pad, local), start, length, pad)
            kept: dict = {}
            logit = model.logits(table, laid, pad, kept)
            loss, slope = doc_slopes(logit.astype(np.float64), text, y[rows], weight[rows])
            grads = model.gradients(part, laid, kept, slope / np.float32(len(rows)))
            done += 1
            size = np.sqrt(sum(float((grads[n] ** 2).sum()) for n in names))
            for n in names:
                g = grads[n] / max(1.0, size)
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                getattr(model, n)[...] -= pace * (first[n] / (1 - 0.9**done)) / (np.sqrt(second[n] / (1 - 0.999**done)) + 1e-8)
            for n, row, holder in (("word", part.word_row, None), ("char", part.gram_row, part.gram_word)):
                at = np.argsort(row, kind="stable")
                used, group = np.unique(row[at], return_inverse=True)
                g = summed(grads[n], group, used.size, at if holder is None else holder[at])
                power = (g * g).mean(axis=1)
                usual[n] += max(0.02, 1 / done) * (float(power.mean()) - usual[n])
                seen[n][used] += power
                getattr(model, n)[used] -= 5 * pace * g / np.sqrt(seen[n][used] + usual[n] + 1e-20)[:, None]
    return model


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, apart: np.ndarray, **options) -> Model | float:
    """The model, or a rate where there is nothing to tell apart. Rows marked apart fit the final logistic alone."""
    if not y.size or y.min() == y.max():
        return float(y.mean()) if y.size else 0.5
    known = Numbers()
    ids, sizes = numbered(known, map(words_in, texts))
    words = Words.of(list(known))
    both = [len(set(y[m].tolist())) == 2 for m in (apart, ~apart)]
    learn = ~apart if all(both) else np.ones(y.size, bool)
    check = np.flatnonzero(apart if all(both) else learn)
    model = train(words, texts_of(ids, sizes, np.flatnonzero(learn)), sizes[learn], y[learn], weight[learn], **options)
    text, logit = block_logits(model, model.entries(words), texts_of(ids, sizes, check), sizes[check])
    model.final = final_weights(totals(logit, text, check.size), y[check], weight[check])
    return model


class Reader:
    """Scores texts in pieces; what a word brings to the network is made once while it stays cached."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known = Numbers()
        self.table = np.zeros((3, 2, 1, HIDDEN), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > CACHED:
            self.clear()
        had = len(self.known)
        ids, sizes = numbered(self.known, map(words_in, texts))
        if len(self.known) > had:
            made = self.model.entries(Words.of(list(islice(self.known, had, None))))
            self.table = np.concatenate([self.table[:, :, :had], made], axis=2)
        text, logit = block_logits(self.model, self.table, ids, sizes)
        return 1 / (1 + np.exp(-np.clip(totals(logit, text, sizes.size) @ self.model.final, -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_fold: int = 2, threshold: float = 0.3, sample: int = SAMPLE, longest: int = LONGEST, scratch: Scratch | None = None) -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    marks = labels.filter(quoted(label).isNotNull()).groupBy(quoted(key).alias("l")).agg(F.min(quoted(label)).cast("int").alias("y"))
    marks = scratch.keep(marks.filter((crc_bucket(F.col("l"), folds) != held_fold) & F.col("y").isin(0, 1)), "marks")
    number = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample / 2 / n) for y, n in number.items()}
    place = F.pmod(F.xxhash64("l", F.lit(12)), F.lit(1 << 30))
    within = F.lit(False)
    for y, part in share.items():
        within = within | ((F.col("y") == y) & (place < int(part * (1 << 30))))
    learn = rows.join(marks.filter(within), F.col("key") == F.col("l")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    learn = learn.groupBy("key", "y").agg(F.min("text").alias("text"), (F.min(place) % 4 == 0).alias("apart")).toPandas().sort_values("key")  # one row a key
    y = learn["y"].to_numpy(np.float64)
    weight = np.array([1 / share[int(v)] for v in y])
    model = fit([t or "" for t in learn["text"]], y, weight / weight.mean() if y.size else weight, learn["apart"].to_numpy(bool))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None if isinstance(model, float) else Reader(model)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                texts = part.column(1).to_pylist()
                found = np.full(len(texts), model) if reader is None else reader.scores(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["key", "score"])

    scored = rows.mapInArrow(score, T.StructType([rows.schema["key"], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("key").alias(key), (crc_bucket(F.col("key"), folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity_scores(docs, labels)
