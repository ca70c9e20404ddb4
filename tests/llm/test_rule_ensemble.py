import numpy as np

from tesserae.llm import rule_ensemble as r


def test_statistics():
    s = dict(zip(r.STATS, r.statistics("the the cat sat.\n\nTHE #1 the cat sat.")))
    assert s["distinct"] == 6 / 10 or s["distinct"] == len({"the", "cat", "sat.", "THE", "#1"}) / 9
    assert s["same_as_before"] == 1 / 9 and s["top_word"] == 3 / 9
    assert r.statistics(None) == r.statistics(" \n") == [0.0] * len(r.STATS)
    assert len(r.statistics("x")) == len(r.STATS)


def test_fit_finds_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(r.STATS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    b, rules = r.fit(x[:3000], y[:3000])
    score = b + sum(w * r.holds(rule, x[3000:]) for w, rule in rules)
    assert ((score > 0) == (y[3000:] > 0)).mean() > 0.97
    assert len(rules) < 150


def test_one_class_and_none():
    b, rules = r.fit(np.zeros((5, len(r.STATS))), np.ones(5))
    assert rules == [] and b > 0
    assert r.fit(np.zeros((0, len(r.STATS))), np.zeros(0)) == (0.0, [])


def test_expression_equals_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((500, len(r.STATS)))
    b, rules = r.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    df = spark.createDataFrame([tuple(map(float, row)) for row in x], list(r.STATS))
    got = np.array([v[0] for v in df.select(r.compiled(b, rules)).collect()])
    want = 1 / (1 + np.exp(-(b + sum(w * r.holds(rule, x) for w, rule in rules))))
    assert np.abs(np.sort(got) - np.sort(want)).max() < 1e-9


def test_held_out_accuracy_and_edges(spark):
    sf = "/root/testdata/sf0.01"
    rows = r.query(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = rows.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert rows.count() == 1000 and len(held) > 50
    assert np.mean([x["predicted"] == x["quality"] for x in held]) > 0.9
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "x " * 50_000, 0.0), (2, "x " * 50_000, 0.0)], "doc_id long, text string, score double")
    got = r.quality_scores(odd, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")).collect()
    assert len(got) == 4 and all(0 <= x["score"] <= 1 for x in got)
    assert r.quality_scores(odd.limit(0), labels).collect() == []


def plain_statistics(text):
    """The statistics by loops over characters and words; white space is that of ASCII."""
    import re

    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return [0.0] * len(r.STATS)
    n, size = len(words), sum(len(w.encode()) for w in words)
    share = lambda signs: sum(text.count(c) for c in signs) / size
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    last_odd = lambda w: ord(w[-1]) < 128 and not w[-1].isalpha() and w[-1] not in ".,;:!?"
    return [
        np.log(n + 1), size / n, share("#*$%&|<>"), share(".,;:!?'\"()-"), share("0123456789"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("{}[]\\^_`~@=+/"), sum(ord(c) > 127 for c in text) / size,
        len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(words[i] == words[i + 1] for i in range(n - 1)) / n, n / len(lines), 1 - len(set(lines)) / len(lines),
        1 - len(set(triples)) / len(triples) if triples else 0.0, n / (1 + sum(text.count(c) for c in ".!?")), sum(len(w.encode()) > 20 for w in words) / n, sum(map(last_odd, words)) / n,
    ]


def test_statistics_against_plain_code(spark):
    rows = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    odd = [None, "", " \n", "one", "a a a a", "é ü 😀!", "A\n\nA\nB", "x" * 3000, "10% of_it {a} <b>", "\x0b t\x0cu"]
    for text in [x for x in rows if x is None or len(x) < 20_000] + odd:
        assert np.allclose(r.statistics(text), plain_statistics(text), rtol=1e-12, atol=1e-12), text


def test_lasso_weights_are_the_least(spark):
    """Against coordinate descent in plain loops, and the conditions that hold only at the minimum."""
    rng = np.random.default_rng(4)
    z = (rng.random((600, 12)) < 0.4).astype(float)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    y = (1 / (1 + np.exp(-(1.5 * z[:, 0] - z[:, 3] + 0.3))) > rng.random(600)).astype(float)
    penalty = 0.02
    b, w = r.lasso(z, y, penalty, steps=5000)
    c, plain = 0.0, [0.0] * 12
    for _ in range(400):
        for j in range(-1, 12):
            p = [1 / (1 + np.exp(-t)) for t in z @ np.array(plain) + c]
            if j < 0:
                c -= 4 * float(np.mean(p - y))
            else:
                step = plain[j] - 4 * float(np.mean((p - y) * z[:, j]))
                plain[j] = max(abs(step) - 4 * penalty, 0) * (1 if step > 0 else -1)
    assert np.abs(w - plain).max() < 1e-4 and abs(b - c) < 1e-4
    slope = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-5) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)


def test_learns_from_about_the_sample_whatever_the_partitions(spark, monkeypatch):
    seen = []
    fit = r.fit
    monkeypatch.setattr(r, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat_ws(' ', 'w', id, id % 7) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    scores = [{x["doc_id"]: x["score"] for x in r.quality_scores(docs.repartition(n).unionByName(docs), labels, sample=500).collect()} for n in (1, 16)]
    assert scores[0] == scores[1] and seen[0] == seen[1] and 400 < seen[0] < 600
