"""A quality classifier as a sparse ensemble of rules.

Boosted shallow trees over statistics of the text give rules: every path from a root to a node
is a conjunction of thresholds. A lasso logistic regression weighs the rules and drops most;
those left are compiled into one Spark column expression, so scoring runs inside the JVM over
the statistics, for every row.

Learning uses about `sample` labelled keys, one row each, held on the driver: all of them where
there are no more, else those whose hash lies below sample / their number, so that the driver gets
the same bytes however many rows and partitions there are. Everything else covers all rows. The
statistics are counted by a loop over each text in Arrow batches, not in the JVM.

Defined cases: a null text has the statistics of an empty one; null keys count as '' in the
split; of several labels of a key the least counts; rows that repeat are scored alike; without
labels, or with one class only, the score is that class's rate (0.5 without labels); an empty
table gives an empty result; only the key of the input is kept, so no name clashes; texts of any
length are counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_bucket, pieces, quoted

STATS = ("log_words", "word_length", "symbols", "punctuation", "digits", "upper", "marks", "non_ascii", "distinct", "top_word", "same_as_before", "line_words", "dup_lines", "repeated_trigrams", "sentence_words", "long_words", "odd_words")
SAMPLE, TREES, DEPTH, BINS = 20_000, 24, 3, 32
PENALTY, STEPS = 1e-3, 400


# --- statistics ----------------------------------------------------------------------------

_CLASS = np.zeros((256, 6))
for _i, _signs in enumerate((b"#*$%&|<>", b".,;:!?'\"()-", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"{}[]\\^_`~@=+/")):
    _CLASS[list(_signs), _i] = 1
_CLASS[128:192, 5] = 0
_CLASS[192:, 5] = 1


def statistics(text: str | None) -> list[float]:
    """The values of STATS; ratios are 0 where there is nothing to divide by."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    signs = counts @ _CLASS
    chars = sum(map(len, words))
    freq = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    trigrams = Counter(zip(words, words[1:], words[2:]))
    return [
        float(np.log1p(n)), chars / n, *(signs / chars), len(freq) / n, max(freq.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, n / len(lines),
        1 - len(set(lines)) / len(lines), 1 - len(trigrams) / (n - 2) if n > 2 else 0.0, n / (1 + sum(counts[x] for x in b".!?")), sum(len(w) > 20 for w in words) / n, sum(not w[-1:].isalpha() and w[-1] < 128 and w[-1:] not in b".,;:!?" for w in words) / n,
    ]


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            values = np.array([statistics(x) for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(len(STATS))]], names=["key", *STATS])


def text_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    return rows.mapInArrow(_stats, T.StructType([rows.schema["key"], *[T.StructField(s, T.DoubleType()) for s in STATS]]))


# --- learning ------------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold) each


def grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of one regression tree's nodes and the tree's Newton step for each row."""
    rules, step = [], np.zeros(len(gradient))

    def split(rows: np.ndarray, path: Rule, level: int) -> None:
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, -1, -1)
        if level < depth and rows.size >= 2 * least:
            for f, edge in enumerate(edges):
                if not edge.size:
                    continue
                code = binned[rows, f]
                n = np.cumsum(np.bincount(code, minlength=edge.size + 1))[:-1]
                gl = np.cumsum(np.bincount(code, gradient[rows], edge.size + 1))[:-1]
                hl = np.cumsum(np.bincount(code, weight[rows], edge.size + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < least) | (rows.size - n < least)] = 0
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
        if best[1] < 0:
            step[rows] = g / (h + 1)
            return
        _, f, k = best
        low = binned[rows, f] <= k
        for side, above in ((rows[low], False), (rows[~low], True)):
            inner = (*path, (f, above, float(edges[f][k])))
            rules.append(inner)
            split(side, inner, level + 1)

    split(np.arange(len(gradient)), (), 0)
    return rules, step


def simplified(rule: Rule) -> Rule:
    """One bound a side of each statistic."""
    bound: dict[tuple[int, bool], float] = {}
    for f, above, t in rule:
        bound[f, above] = t if (f, above) not in bound else (max if above else min)(bound[f, above], t)
    return tuple(sorted((f, above, t) for (f, above), t in bound.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule])


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, [(weight, rule)]); weights are never 0."""
    rate = float(y.mean()) if y.size else 0.5
    if y.size == 0 or rate in (0.0, 1.0):
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return float(np.log(rate / (1 - rate))), []
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(y.size, np.log(rate / (1 - rate)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rules, step = grow(binned, edges, y - p, p * (1 - p), depth, max(5, y.size // 500))
        score += 0.3 * step
        found.update(dict.fromkeys(map(simplified, rules)))
    rules = list(found)
    if not rules:
        return float(np.log(rate / (1 - rate))), []
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32)
    spread = z.std(axis=0)
    z, rules = z[:, spread > 0], [r for r, s in zip(rules, spread) if s > 0]
    mean, spread = z.mean(axis=0), z.std(axis=0)
    b, w = lasso((z - mean) / spread, y, penalty)  # standardised, so that one penalty fits all rules
    kept = np.flatnonzero(w)
    weights = w[kept] / spread[kept]
    return b - float(weights @ mean[kept]), [(float(a), rules[k]) for a, k in zip(weights, kept)]


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights that make the mean logistic loss plus penalty * sum |w| least."""
    rate = float(y.mean())
    w, b = np.zeros(z.shape[1]), float(np.log(rate / (1 - rate)))
    v, vb, t = w.copy(), b, 1.0
    power = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(30):
        power = z.T @ (z @ power)
        size = float(np.linalg.norm(power))
        power /= size
    rate_of = 4.0 * y.size / (size + y.size)
    for _ in range(steps):  # accelerated proximal gradient
        error = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - rate_of * (z.T @ error) / y.size
        new = np.sign(new) * np.maximum(np.abs(new) - rate_of * penalty, 0)
        new_b = vb - rate_of * float(error.mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    return b, w


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble's probability as an expression over the columns of STATS."""
    total = F.lit(intercept)
    for weight, rule in rules:
        hold = reduce(lambda a, b: a & b, [(F.col(STATS[f]) > t) if above else (F.col(STATS[f]) <= t) for f, above, t in rule])
        total = total + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held_fold: int = 2, threshold: float = 0.7, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    scratch = scratch or Scratch(docs.sparkSession)
    stats = scratch.keep(text_statistics(docs, key, text), "stats")
    held = crc_bucket(F.col("key"), folds) == held_fold
    marks = labels.filter(quoted(label).isNotNull()).groupBy(quoted(key).alias("l")).agg(F.min(quoted(label)).alias("y"))
    marks = scratch.keep(marks.filter(crc_bucket(F.col("l"), folds) != held_fold), "marks")
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("l", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    learn = stats.join(marks, F.col("key") == F.col("l")).groupBy("key", "y").agg(F.min(F.struct(*STATS)).alias("x"))  # one row a key
    learn = learn.select("x.*", "y").toPandas().sort_values([*STATS, "y"])
    intercept, rules = fit(learn[list(STATS)].to_numpy(dtype=np.float64), learn["y"].to_numpy(dtype=np.float64))
    scored = stats.select(F.col("key").alias(key), held.alias("held_out"), compiled(intercept, rules).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_scores(docs, labels)
