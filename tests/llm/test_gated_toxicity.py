"""The network against differences and a plain reading word by word; windows, totals, edges and held-out labels."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import gated_toxicity as G


def small(seed=0):
    rng = np.random.default_rng(seed)
    texts = [[bytes([97 + rng.integers(0, 4)]) * int(rng.integers(1, 9)) for _ in range(n)] for n in (0, 3, 50, 90)]
    known = G.Numbers()
    ids, sizes = G.numbered(known, texts)
    return texts, list(known), ids, sizes, G.Model.fresh(1, 0.2)


def plain_logit(model, words):
    """One window, word by word, in double precision, straight from the definitions."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, H = len(words), G.HIDDEN
    states = np.zeros((n, 2, H))
    for side in (0, 1):
        h = np.zeros(H)
        for i in range(n) if side == 0 else range(n - 1, -1, -1):
            x = (G.Words.of([words[i]]).vectors(model)[0].astype(float) @ model.enter + model.shift).reshape(2, 3, H)[side]
            turned = [h @ model.turn[g, side].astype(float) for g in range(3)]
            reset, update = sigmoid(x[0] + turned[0]), sigmoid(x[1] + turned[1])
            new = np.tanh(x[2] + reset * turned[2])
            h = states[i, side] = (1 - update) * new + update * h
    if not n:
        return float(model.base[0])
    heed = np.einsum("nsh,sh->n", states, model.heed)
    alpha = np.exp(heed - heed.max())
    return float((alpha / alpha.sum() * np.einsum("nsh,sh->n", states, model.read)).sum() + model.base[0])


def test_windows_cover_every_word_and_overlap():
    sizes = np.array([0, 1, G.WINDOW, G.WINDOW + 1, 1000])
    text, start, length = G.windows(sizes)
    first = np.cumsum(sizes) - sizes
    for t, n in enumerate(sizes):
        mine = text == t
        seen = sorted({i for a, k in zip(start[mine] - first[t], length[mine]) for i in range(a, a + k)})
        assert seen == list(range(n)) and mine.sum() >= 1
        assert (start[mine][1:] < (start[mine] + length[mine])[:-1]).all()


def test_logits_equal_a_plain_reading():
    texts, known, ids, sizes, model = small()
    text, logit = G.block_logits(model, model.entries(G.Words.of(known)), ids, sizes)
    want = [plain_logit(model, words[a : a + G.WINDOW]) for words in texts for a in range(0, max(1, len(words) - G.WINDOW + G.STRIDE), G.STRIDE)]
    assert text.tolist() == sorted(text.tolist()) and np.allclose(logit, want, atol=1e-4)


def test_gradients_equal_differences():
    _, known, ids, sizes, model = small()
    for n in ("word", "char", "enter", "shift", "turn", "heed", "read", "base"):
        setattr(model, n, getattr(model, n).astype(np.float64))
    words, y, weight = G.Words.of(known), np.array([0, 1.0, 0, 1]), np.array([1.0, 2, 1, 1])
    text, start, length = G.windows(sizes)
    laid = G.laid_out(ids, start, length, len(known))
    kept: dict = {}
    logit = model.logits(model.entries(words), laid, len(known), kept)
    grads = model.gradients(words, laid, kept, G.doc_slopes(logit.astype(float), text, y, weight)[1])
    loss = lambda: G.doc_slopes(model.logits(model.entries(words), laid, len(known)).astype(float), text, y, weight)[0]
    rng = np.random.default_rng(3)
    places = [(n, tuple(rng.integers(0, d) for d in getattr(model, n).shape)) for n in ("enter", "shift", "turn", "heed", "read", "base") for _ in range(3)]
    places += [("word", (words.word_row[2], 3)), ("char", (words.gram_row[5], 3))]
    for n, at in places:
        table = getattr(model, n)
        old = table[at]
        table[at] = old + 1e-2
        up = loss()
        table[at] = old - 1e-2
        slope = (up - loss()) / 2e-2
        table[at] = old
        if n == "word":
            mine = grads[n][words.word_row == at[0]][:, at[1]].sum()
        elif n == "char":
            mine = grads[n][words.gram_word[words.gram_row == at[0]]][:, at[1]].sum()
        else:
            mine = grads[n][at]
        assert mine == pytest.approx(slope, rel=2e-2, abs=2e-5), n


def test_summed_equals_a_loop():
    rng = np.random.default_rng(0)
    group = np.sort(np.concatenate([rng.integers(0, 50, 300), np.full(200, 7)]))
    values = rng.standard_normal((group.size, 3))
    rows = rng.permutation(group.size)
    want = np.zeros((51, 3))
    np.add.at(want, group, values[rows])
    assert np.allclose(G.summed(values, group, 51, rows), want)


def test_grams_have_the_ends_of_words():
    word, row = G.char_grams([b"abc", b"a", b"abcd"])
    grams = lambda w: len(range(len(w) + 2 - 3 + 1)) + max(0, len(w) + 2 - 5 + 1) + max(0, len(w) + 2 - 7 + 1)
    assert np.bincount(word).tolist() == [grams("abc"), grams("a"), grams("abcd")]
    assert row[word == 0][0] == row[word == 2][0]  # the same beginning


def test_a_cached_word_scores_as_a_new_one():
    texts, *_ , model = small(2)
    plain = [b" ".join(t).decode() for t in texts]
    reader = G.Reader(model)
    first = reader.scores(plain)
    assert np.allclose(first, reader.scores(plain)) and np.allclose(first[::-1], G.Reader(model).scores(plain[::-1]), atol=1e-6)


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = G.toxicity_scores(docs, labels)
    rows = out.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], r["toxic"]) for r in rows if r["held_out"]]
    good = [s for s, t in held if t]
    bad = [s for s, t in held if not t]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([a >= 0.3 for a in good]) > 0.85 and np.mean([b >= 0.3 for b in bad]) < 0.03


def test_labels_of_held_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "vile scum there") for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.lit(1) - F.col("doc_id") % 2).cast("int").alias("toxic"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r["doc_id"]: r["score"] for r in G.toxicity_scores(docs, x).collect()}
    a, b = score(labels), score(turned)
    assert a == b and min(a[i] for i in range(0, 120, 2)) > max(a[i] for i in range(1, 120, 2))


ROWS = [(1, "one two", 0), (1, "one two", 0), (2, None, 1), (None, "no id", None), (3, "", 1), (4, " \n", 0), (5, "word other. " * 20_000, 1), (6, "x" * 100_000, 0), (7, "ünï😀 \x00\x0b ￿", None), (None, None, None)]


@pytest.mark.parametrize("only", [None, 0, 1, "none"])
def test_odd_rows(spark, only):
    docs = spark.createDataFrame([(a, b) for a, b, _ in ROWS], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("key", "score", "l", "y", "predicted", "held_out")})
    labels = spark.createDataFrame([(a, c) for a, _, c in ROWS], "doc_id long, toxic int").withColumn("text", F.lit("own"))
    labels = labels.limit(0) if only == "none" else labels if only is None else labels.filter(F.col("toxic") == only)
    rows = G.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    if only is not None:
        assert {r["score"] for r in rows} == {0.5 if only == "none" else float(only)}
    assert G.toxicity_scores(docs.limit(0), labels).collect() == []
