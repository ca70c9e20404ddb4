"""Nulls in any column, empty and very long texts, ties, repeated rows, no rows, and input columns
named like outputs or internals, for every operator on documents."""

import pytest
from pyspark.sql import functions as F

from tesserae.llm import gated_toxicity, host_rules, jaccard_join, lm_trie, media_docs, mixing, periodic_runs, piece_codec, rule_ensemble, substring_dedup, token_counts, zip_warc
from tesserae.llm.common import Scratch

LONG = "word other. " * 20_000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1), (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1), (2, None, None, None, None), (None, "text with null id and a few more words to make ten of them", None, "b", 2),
    (None, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4), (5, LONG, "en", "c", 5), (6, "x" * 100_000, "en", None, 6), (7, "ünï😀 " * 30 + "\x00\x0b\x0c ￿", "fr", "b", 7),
]
#: Names of outputs and of columns inside the operators.
CLASHES = ["n_words", "kept", "host", "rejected", "n", "size", "source_size", "target", "copies", "src", "class_id", "node", "label", "ids", "decoded", "row", "key", "h", "k", "p", "start", "stop", "words", "clean_text", "removed", "digest", "media", "n_bytes", "held_out", "score", "predicted", "items", "file", "ordinal"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}).cache()


RUNS = {
    "host_rules": lambda d: host_rules.host_rules(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "jaccard": lambda d: jaccard_join.similar_texts(d),
    "dedup": lambda d: substring_dedup.dedup_passages(d),
    "encode": lambda d: piece_codec.decode_ids(piece_codec.encode_texts(d, piece_codec.default_model()), piece_codec.default_model()),
    "lm": lambda d: lm_trie.score_texts(d),
    "quality": lambda d: rule_ensemble.quality_scores(d, d.select("doc_id", (F.col("n_chars") % 2).alias("quality"))),
    "runs": lambda d: periodic_runs.periodic_runs(d, keep=["lang", "runs", "start"]),
    "toxicity": lambda d: gated_toxicity.toxicity_scores(d, d.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("toxic"))),
    "store": lambda d: media_docs.stored_payloads(d, "text", Scratch(d.sparkSession)),
    "items": lambda d: media_docs.interleaved(d, html="text"),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_and_names(docs, name):
    out = RUNS[name](docs)
    assert len(out.columns) == len({c.lower() for c in out.columns})
    assert len(out.collect()) == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_no_rows(docs, name):
    assert RUNS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["host_rules", "mixing", "dedup", "encode"])
def test_other_columns_come_back(docs, name):
    out = RUNS[name](docs).filter("doc_id = 5").first()
    assert out["file"] == "own file" and out["lang"] == "en" and out["text"] == LONG


def test_defined_results(docs):
    rows = {r["doc_id"]: r for r in host_rules.host_rules(docs).collect()}
    assert not rows[1]["base_failed"] and rows[3]["base_failed"] and rows[5]["base_failed"] and not rows[3]["kept"]
    assert rows[5]["n_words"] == rows[5]["n_repeat_words"] == 40_000
    classes = [(r["doc_id"], r["class_id"], r["n_copies"]) for r in jaccard_join.similar_texts(docs).collect()]
    assert classes.count((1, 1, 2)) == 2 and (3, 3, 1) in classes
    assert all(r["decoded"] == (r["text"] or "") for r in RUNS["encode"](docs).collect())


def test_warc_and_tokens_take_odd_rows(spark, docs):
    scratch = Scratch(spark)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "digest", "row")
    zip_warc.write_packages(pages, scratch.path("a"), scratch)
    assert zip_warc.resolved_facts(spark, scratch.path("a"), scratch).count() == len(ROWS)
    import public_tokenizers

    order = token_counts.write_flat(docs, scratch.path("t"), scratch, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, eod=50256)
    assert order.count() == len(ROWS) == token_counts.count_documents(token_counts.list_flat(spark, scratch.path("t")), 50256, scratch, 4096).count()
