import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import lm_trie as lm


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (7, 5), (1000, 2**64 - 1), (5000, 4000), (70_000, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    ef = lm.EliasFano(*lm.EliasFano.arrays(values))
    assert (ef.get(np.arange(n)) == values).all()
    x = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), np.array([0, top, min(top + 1, 2**64 - 1)], dtype=np.uint64)])
    assert (ef.successor(x) == np.searchsorted(values, x)).all()


def brute(rows, prior=lm.PRIOR):
    split = [((t or "").lower().split() if (t or "").isascii() else (t or "").split(), zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0) for k, t in rows]
    split = [(["<s>", *w, "</s>"], h) for w, h in split]
    uni, bi = Counter(), Counter()
    for w, held in split:
        if not held:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    starts = sum(1 for _, h in split if not h)
    out = []
    for w, held in split:
        p = lambda x: (uni[x] + 0.1) / (n + 0.1 * (v + 1))
        c = lambda x: starts if x == "<s>" else uni[x]
        out.append((held, len(w) - 1, sum(uni[x] > 0 for x in w[1:]), n, sum(math.log10(p(x)) for x in w[1:]), sum(math.log10((bi[a, b] + prior * p(b)) / (c(a) + prior)) for a, b in zip(w, w[1:]))))
    return out


@pytest.mark.parametrize("shard_tokens", [16, 400, lm.SHARD_TOKENS])
def test_scores_match_brute_force(spark, shard_tokens):
    rows = [(i, " ".join(f"W{(i * j * 7) % (5 + i % 11)}" for j in range(i % 40))) for i in range(120)] + [(500, None), (None, "a b"), (7, "W1 W2"), (7, "W1 W2")]
    got = sorted(tuple(r[1:]) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), shard_tokens=shard_tokens).collect())
    compare(got, sorted(brute(rows)))


def compare(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-9 and abs(g[5] - w[5]) < 1e-3 * max(1, w[1])


def test_a_pair_in_half_of_all_tokens_never_travels(spark):
    """One pair is hot in training, one in held-out texts alone; a shard still gets few tokens of either."""
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, ("x y " * 30 if k % 2 else f"u{k} v{k % 7} ") + f"w{k}") for k in range(400)] + [(held[0], "p q " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = lm.Scratch(spark)
    got = sorted(tuple(r[1:]) for r in lm.score_texts(docs, shard_tokens=800, scratch=scratch).collect())
    compare(got, sorted(brute(rows)))
    hot = {(r["word"], r["context"]): r["n"] for r in spark.read.parquet(scratch.path("hot_pairs")).collect()}
    name = lambda w: int(np.uint64(lm.xxhash.xxh64_intdigest(w)).view(np.int64))
    assert hot[name(b"y"), name(b"x")] > 5000 and hot[name(b"q"), name(b"p")] == 0


def test_probabilities_sum_to_one():
    counts, pairs, prior = {"a": 3, "b": 1}, {("a", "b"): 1, ("a", "a"): 2}, 5.0
    n, v = 4, 2
    p = lambda x: (counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))
    total = sum((pairs.get(("a", x), 0) + prior * p(x)) / (3 + prior) for x in ("a", "b", "unseen"))
    assert abs(total - 1) < 1e-12


def test_empty(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_gains_on_held_out_text(spark):
    rows = lm.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and any(r["held_out"] for r in rows)
    trained = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in trained) > sum(r["base_score"] for r in trained)
