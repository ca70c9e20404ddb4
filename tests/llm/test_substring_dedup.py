import random

from tesserae.llm import substring_dedup as s


def brute(rows, min_words=s.MIN_WORDS):
    """rows of (key, text): removed spans and clean texts, by plain loops."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        text = rows[i][1]
        if text is None:
            out[i] = (None, [])
            continue
        marks = []
        for a, b, n, d in s.cut_units(text):
            marks.append((a, b, n, d in seen))
            seen.add(d)
        spans, run = [], []
        for m in [*marks, (0, 0, 0, False)]:
            if m[3]:
                run.append(m)
                continue
            if sum(x[2] for x in run) >= min_words:
                spans.append((run[0][0], run[-1][1], sum(x[2] for x in run)))
            run = []
        clean, at = "", 0
        for a, b, _ in spans:
            clean, at = clean + text[at:a], b
        out[i] = (clean + text[at:], spans)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    sentences = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 14))).capitalize() + rng.choice([".", "!", "?", ".###"]) for _ in range(60)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(sentences) for _ in range(rng.randint(0, 25)))) for i in range(150)] + [(900, None), (901, ""), (902, "😀 x. " * 40), (903, "a " * 50_000)]
    got = {r["doc_id"]: r for r in s.dedup_passages(spark.createDataFrame([(k, t, "own") for k, t in rows], "doc_id long, text string, removed string")).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for i, (k, _) in enumerate(rows):
        assert got[k]["clean_text"] == want[i][0]
        assert [tuple(x) for x in got[k]["removed"]] == want[i][1]


def test_cuts_cover_the_text():
    text = "One two. Three?! four\n\nfive.### six, 1,5"
    assert [text[a:b] for a, b, _, _ in s.cut_units(text)] == ["One two.", " Three?!", " four\n", "five.###", " six,", " 1,5"]


def test_passage_inside_lines_is_removed_once(spark):
    passage = "Alpha beta gamma delta. " + " ".join(f"p{i}" for i in range(60)) + ". Omega last words here."
    rows = [(1, f"Own start one. {passage} Own end one."), (2, f"Another start. {passage} Another end."), (3, "Clean text. Nothing shared.")]
    got = {r["doc_id"]: r["clean_text"] for r in s.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Another start. Another end."


def test_null_keys_repeats_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(20)) + "."
    rows = [(None, long), (5, long), (5, long), (None, None)]
    got = sorted((str(r["doc_id"]), str(r["clean_text"])) for r in s.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("5", long), ("5", long), ("None", ""), ("None", "None")])
    assert s.dedup_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_repeat_goes_without_a_least_length(spark):
    rows = [(1, "Short line.\nOwn one here."), (2, "Own two here.\nshort  LINE."), (3, "A passage without any stops " + "that goes on " * 5), (4, "Joined to A passage without any stops " + "that goes on " * 5)]
    got = {r["doc_id"]: r["clean_text"] for r in s.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=1).collect()}
    assert got == {**dict(rows), 2: "Own two here.\n"}  # a passage that shares no cut with its copy stays
