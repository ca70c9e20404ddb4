import random

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import jaccard_join as j
from tesserae.llm.common import Scratch
from tesserae.session import Steps


def brute(rows, t=0.8):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {}
    for k, text in rows:
        sets.setdefault(shingles(text), []).append(k)
    nodes = [s for s in sets if s]
    root = {s: s for s in nodes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links = dict.fromkeys(nodes, 0)
    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a], nodes[b]
            if len(x & y) >= t * len(x | y) - 1e-9:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = {}
    for s in nodes:
        ks = [k for k in sets[s] if k is not None]
        if ks:
            least[find(s)] = min(least.get(find(s), ks[0]), *ks)
    out = []
    for k, text in rows:
        s = shingles(text)
        out.append((k, least.get(find(s)), links[s], len(sets[s])) if s else (k, k, 0, 1))
    return sorted(out, key=str)


def noisy(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randint(0, 10**6)}"
    return " ".join(words)


def make_rows():
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randint(1, 9)):
            rows.append(noisy(rng, base, rng.choice([0, 0, 1, 2, 4])))
    big = [f"b{i}" for i in range(200)]
    rows += [noisy(rng, big, rng.choice([1, 2, 3, 5])) for _ in range(60)]
    rows += ["one two", "one two", "ONE two", "", "   ", None, "a b c d e"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(None, "one two"), (3, rows[3])]


@pytest.mark.parametrize("block", [8, 512])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(j, "GROUP_BLOCK", block)
    monkeypatch.setattr(j, "BUCKET_BLOCK", block)
    rows = make_rows()
    got = j.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert j.similar_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    plan = j.needed(0.8, j.TOLERANCE)
    rng = np.random.default_rng(0)
    one = np.zeros(j.HASHES, dtype=np.uint32)
    near = (rng.random((20_000, j.HASHES)) > 0.8).astype(np.uint32)
    far = (rng.random((20_000, j.HASHES)) > 0.3).astype(np.uint32)
    assert len(j.survivors(one, near, plan)) >= 19_995
    assert len(j.survivors(one, far, plan)) == 0


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text, 1), (2, text, 2), (None, text, 3), (9, "x", 4)], "doc_id long, text string, class_id int")
    kept = j.one_of_each(docs, j.similar_texts(docs)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 9]


@pytest.mark.parametrize("verdicts", [True, False])
def test_one_of_each_where_keys_do_not_tell_rows_apart(spark, verdicts):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [
        (1, a, "p"), (None, a, "q"), (None, b, "r"), (None, "", "s"), (None, None, "t"), (None, "", "s"),  # one null key in a class with an id
        (None, c, "u"), (None, c, "v"), (None, c + " more", "w"),  # null keys only
        (5, a, "x"), (5, d, "y"),  # one key, one of its texts a copy
        (7, e, "z"), (7, e, "z"), (7, e.upper(), "z"), (8, e, "z"),  # copies that share the least key
        (9, " ", "i"), (9, " ", "i"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(map(tuple, j.one_of_each(docs, j.similar_texts(docs, verdicts=verdicts) if verdicts else j.similar_texts(docs)).collect()), key=str)
    of = lambda *texts: [r for r in kept if r[1] in texts]
    assert of(a) == [(1, a, "p")] and of(b) == [(None, b, "r")] and of(d) == [(5, d, "y")]
    assert len(of(c, c + " more")) == 1 and len(of(e, e.upper())) == 1 and of(e, e.upper())[0][0] == 7
    assert len(of("", None)) == 3 and len(of(" ")) == 2 and len(kept) == 10


def test_equal_rows_send_one_set():
    text = " ".join(f"w{i}" for i in range(40))
    batch = lambda nodes: pa.RecordBatch.from_pydict({"node": nodes, "label": [1] * len(nodes), "members": [3] * len(nodes), "text": [f"{text} {n}" for n in nodes]})
    got = list(j._members(iter([batch([7] * 5000), batch([]), batch([7] * 10 + [2] * 10), batch([2, 9, 9])])))
    assert [n for b in got for n in b.column(0).to_pylist()] == [7, 2, 9]
    assert [len(s) for b in got for s in b.column(3).to_pylist()] == [37 * 8] * 3


@pytest.mark.parametrize("key", [1, None])
def test_many_equal_rows_beside_a_near_copy(spark, key):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(key, text)] * 3000 + [(2, text + " more")]
    got = j.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    kept = []
    keep = Steps.keep
    monkeypatch.setattr(Steps, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    order = [0, *range(60, 0, -1)]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    got = j.components(edges, Scratch(spark), "path").collect()
    assert {tuple(r) for r in got} == {(n, 0) for n in range(61)} and kept.count("hooks") < 10
