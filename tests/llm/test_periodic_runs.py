"""Runs against a direct search over all periods; masking, ties, nulls, long and one-word texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm.periodic_runs import gram_size, main_lorentz, periodic_runs, runs_of, strongest, surviving


def plain_runs(w, least=6, times=4):
    """All (start, stop, period) with the least period of their extent."""
    best = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in best.items())


def test_gram_size():
    assert gram_size(6, 4) == 5 and gram_size(2, 2) == 1 and gram_size(10, 3) == 7


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_a_direct_search(seed):
    rng = np.random.default_rng(seed)
    docs = []
    for _ in range(6):
        w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70)).tolist()
        for _ in range(rng.integers(0, 3)):
            root = rng.integers(0, 4, rng.integers(1, 9)).tolist()
            at = rng.integers(0, len(w) + 1)
            w[at:at] = (root * 9)[: rng.integers(1, 9 * len(root))]
        docs.append(w)
    ids = np.array([x for w in docs for x in w], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
    for least, times in ((6, 4), (2, 2), (9, 3)):
        want, base = [], 0
        for w in docs:
            want += [(s + base, e + base, q) for s, e, q in plain_runs(w, least, times)]
            base += len(w)
        assert [tuple(r) for r in runs_of(ids, doc, least, times).tolist()] == sorted(want, key=lambda r: (r[0], r[2]))


def test_words_outside_repeated_grams_do_not_survive():
    ids = np.array([1, 2, 3, 4, 5, 6, 7, 9, 9, 9, 9, 9, 9, 8, 1, 2, 3, 4, 5])
    start, stop = surviving(ids, np.zeros(ids.size, int), 5)
    assert list(zip(start, stop)) == [(0, 5), (7, 13), (14, 19)]
    start, stop = surviving(ids, np.repeat([0, 1], [10, 9]), 5)
    assert not start.size  # grams do not cross documents, nor match those of another one


def test_a_run_across_many_blocks_is_found_once():
    w = np.array([*range(100, 131), *([1, 2, 3] * 400), *range(200, 231)])
    assert main_lorentz(w, np.array([0]), np.array([w.size])).tolist() == [[31, 31 + 1200, 3]]


ROWS = [(1, "a a a a a b"), (2, "a a a a a a b"), (3, None), (4, ""), (5, " \n"), (None, "x y x y x y x y z"), (7, "w " * 50_000), (7, "w " * 50_000), (8, "A a A a A a A a"), (9, "é é é é é é é é"), (10, "q q q q q q " + "u v " * 8 + "k")]


def test_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("runs", F.lit("own")).withColumn("lang", F.lit("en"))
    out = periodic_runs(docs, keep=["lang", "runs"])
    assert out.columns == ["doc_id", "lang", "n_words", "runs", "collapsed"]
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.withColumn("best", strongest(F.col("runs"))).collect()]
    one = {r[0]: r[1:] for r in rows}
    assert len(rows) == len(ROWS)
    assert one[1] == (6, [], "a a a a a b") and one[2] == (7, [(0, 6, 1)], "a b")
    assert one[3] == one[4] == one[5] == (0, [], "")
    assert one[None] == (9, [(0, 8, 2)], "x y z")
    assert one[7] == (50_000, [(0, 50_000, 1)], "w") and one[8] == (8, [(0, 8, 2)], "A a")
    assert one[9] == (7, [(1, 6, 1)], "é é é")
    assert one[10] == (23, [(0, 6, 1), (6, 16, 2)], "q u v k")


def test_strongest_is_exact_and_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, [(0, 999_999_999, 3), (1, 1_000_000_000, 3), (2, 666_666_667, 2)]), (2, []), (3, [(5, 8, 2), (5, 12, 3), (9, 4, 1)])], "k int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r["k"]: r["b"] and tuple(r["b"]) for r in df.select("k", strongest(F.col("runs")).alias("b")).collect()}
    assert got[1] == (2, 666_666_667, 2) and got[2] is None and got[3] == (5, 8, 2)


def test_no_rows(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
