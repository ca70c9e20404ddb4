import numpy as np
import public_tokenizers
import pytest

from tesserae.llm import token_counts as t
from tesserae.llm.common import Scratch


def plain(ids, eod):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == eod:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("eod,block", [(9, 6), (9, 1 << 20), (70_000, 4), (70_000, 40)])
def test_blocks_against_plain_scan(spark, tmp_path, eod, block):
    rng = np.random.default_rng(block)
    want = {}
    for name, n in (("a.bin", 0), ("b.bin", 1), ("c.bin", 57), ("d.bin", 200)):
        ids = rng.integers(0, 12, n) if eod == 9 else np.where(rng.random(n) < 0.1, eod, rng.integers(0, 69_000, n))
        if name == "d.bin":
            ids[50:150] = 1  # a document across many blocks
        (tmp_path / name).write_bytes(ids.astype(t.id_type(eod)).tobytes())
        want[name] = plain(ids.tolist(), eod)
    got = {n: [] for n in want}
    for r in t.count_documents(t.list_flat(spark, str(tmp_path)), eod, Scratch(spark), block).collect():
        got[r["path"].rpartition("/")[2]].append((r["ordinal"], r["start"], r["n_tokens"], r["closed"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_nulls_repeats_and_empty(spark):
    args = {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "eod": 50256}
    scratch = Scratch(spark)
    order = t.write_flat(spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "one two", 0), (2, "one two", 0)], "doc_id long, text string, ordinal int"), scratch.path("x"), scratch, **args)
    assert order.count() == 4
    counts = t.count_documents(t.list_flat(spark, scratch.path("x")), 50256, scratch).collect()
    assert sorted(r["n_tokens"] for r in counts) == [0, 0, 2, 2]
    scratch = Scratch(spark)
    assert t.write_flat(spark.createDataFrame([], "doc_id long, text string"), scratch.path("x"), scratch, **args).count() == 0


def test_query_counts_what_the_encoder_gives(spark):
    sf = "/root/testdata/sf0.001"
    codec = t.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: r["n_tokens"] for r in t.query(spark, sf).collect()}
    want = {r["doc_id"]: len(codec.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == want
