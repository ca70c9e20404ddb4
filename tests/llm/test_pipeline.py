"""run() against plain Python on a small table."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import sentencepiece

import corpus_pipeline
from tesserae.llm import piece_codec

from .test_jaccard_join import brute as jaccard
from .test_substring_dedup import brute as passages


def rules(rows):
    facts = []
    for _, text, _, source in rows:
        words = (text or "").encode().split()
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        chars = sum(len(w.decode()) for w in words)
        facts.append((source, len(words) < 10 or 100 * len(covered) > 20 * len(words), 10 * symbols > chars, 2 * (len(lines) - len(set(lines))) > len(lines)))
    n = Counter(f[0] for f in facts)
    fails = [Counter(f[0] for f in facts if f[r]) for r in (1, 2, 3)]
    rates = []
    for x in fails:
        m, docs = sum(x.values()) / len(facts), len(facts)
        q = sum(x[s] ** 2 / n[s] for s in n) / docs
        beyond = max(q - m * m - m * (1 - m) * len(n) / docs, 1e-12)
        strength = max(1.0, min(1e6, m * (1 - m) / beyond - 1))
        rates.append({s: (x[s] + m * strength) / (n[s] + strength) for s in n})
    return [row for row, (s, *bad) in zip(rows, facts) if not bad[0] and max(r[s] for r in rates) <= 0.5 and not any(b and r[s] > 0.02 for b, r in zip(bad, rates))]


def mixed(rows):
    size = [len((t or "").encode().split()) for _, t, _, _ in rows]
    total = Counter()
    for (_, _, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size), dict(weight), {}
    while free:  # those above their limit stop there and the rest is shared again
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] >= 2 * total[s]]
        if not over:
            target.update({s: level * w for s, w in free.items()})
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            del free[s]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def place(i):
        n, h = size[i], md5(str(rows[i][0]))
        e = (n + 1).bit_length() - 1
        return (e * 8 + math.floor((n + 1) * 8 / 2**e) - 8, int(h[:2], 16), h)

    out, groups = [], defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[3]].append(i)
    for s, members in groups.items():
        rate, u = (target[s] / total[s] if total[s] else 0.0), int(md5(f"{s or ''}|mix")[:8], 16) / 2**32
        for rank, i in enumerate(sorted(members, key=place), 1):
            out += [rows[i]] * (math.floor(rank * rate + u) - math.floor((rank - 1) * rate + u))
    return out


def test_run_against_plain_code(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    near = rows[3][1].split()
    near[len(near) // 2] = "changed"
    rows += [(5000, " ".join(near), "en", None), (5001, None, None, "src1"), (5002, "", "en", "src2"), (5003, "Own words first. " + rows[0][1] + " Own words last.", "fr", rng.choice(["src1", "src3"]))]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    want = rules(rows)
    classes = jaccard([(r[0], r[1]) for r in want])
    keep = {k for k, c, _, _ in classes if k == c}
    want = [r for r in want if r[0] in keep]
    clean = passages([(r[0], r[1]) for r in want])
    want = mixed([(r[0], clean[i][0], r[2], r[3]) for i, r in enumerate(want)])
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = sorted((k, lang, s or "", lib.encode(t or "", add_eos=True)) for k, t, lang, s in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["lang"], r["source"] or "", r["ids"]) for r in got) == want
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
