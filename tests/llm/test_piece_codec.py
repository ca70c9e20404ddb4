import hashlib
import random

import pytest
import sentencepiece

from tesserae.llm import piece_codec as p

MODEL = p.default_model()
HARD = ["", " ", "  ", "   a", "a  b ", "\n", "a\nb\r\nc\t", "é́ ｆｕｌｌ ①  　x", "▁x y▁z", "▁▁ ▁", "<s> </s> <0x0A> <unk>", "x\x00y", "🙂👩‍👩‍👧 ﬁ", " " * 1000 + "x" + " " * 37, "aaaa" * 500, "=" * 3000, "abc" * 2000, "the end", "-" * 17 + " " + "\t" * 20, "中文字符 テスト", "�⁇"]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(codec, lib, texts):
    ids, at = codec.encode(texts)
    want = [lib.encode(t, add_eos=True) for t in texts]
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    for t, g, w in zip(texts, got, want):
        assert g == w, t[:80]
    assert codec.decode(ids, at) == [lib.decode(w) for w in want]


def test_hard_texts(lib):
    same(p.PieceModel(MODEL), lib, HARD)


def test_random_texts(lib):
    rng = random.Random(5)
    alphabet = "  aabeinorst.,\n▁éßE01<>=_-(){}\t中🙂"
    codec = p.PieceModel(MODEL)
    same(codec, lib, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(1500)])
    names = [lib.id_to_piece(i) for i in range(259, 32000)]
    same(codec, lib, ["".join(rng.choice(names) for _ in range(30)) for _ in range(1500)])


def test_table_starts_anew(lib, monkeypatch):
    monkeypatch.setattr(p, "KNOWN_WORDS", 3)
    codec = p.PieceModel(MODEL)
    for _ in range(3):
        same(codec, lib, ["one two three four five", "six seven two"])


def test_decoding_odd_ids(lib):
    codec = p.PieceModel(MODEL)
    import numpy as np

    for ids in ([0, 1, 2], [3 + 0xC3], [3 + 0xE2, 3 + 0x82], [3 + 0xC3, 3 + 0xA9, 300], [2, 300, 2, 301], [1, 28705, 3 + 0xFF, 260], [3 + 0xF0, 3 + 0x9F, 300]):
        assert codec.decode(np.array(ids), np.array([0, len(ids)])) == [lib.decode(ids)], ids


def test_frames(spark, lib):
    df = spark.createDataFrame([(1, "a b", 5), (None, None, None), (3, "", 1), (3, "", 1)], "doc_id long, text string, ids int")
    got = p.decode_ids(p.encode_texts(df, MODEL), MODEL).collect()
    assert [r["ids"] for r in got] == [lib.encode("a b", add_eos=True), [2], [2], [2]]
    assert [r["decoded"] for r in got] == ["a b", "", "", ""]
    assert p.encode_texts(df.limit(0), MODEL).collect() == []


def test_query_matches_library(spark, lib):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in p.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r["text"] or "", add_eos=True)
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
