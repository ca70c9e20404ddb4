import hashlib
import struct
import zlib

import pytest

from tesserae.llm import media_docs as m
from tesserae.llm.common import Scratch


def test_items_in_order_with_captions():
    html = '<title>T</title><style>p{}</style><p>One <b>two</b></p><figure><img src="a.png" alt="alt"><figcaption>The cap &amp; more</figcaption></figure><p>three<img src=b.png alt="only alt">four</p><img alt="no source"><script>x</script><video src="v.mp4"></video>'
    got = [(i["position"], i["kind"], i["text"] or i["reference"], i["caption"]) for i in m.items_of(html)]
    assert got == [(0, "text", "T", None), (1, "text", "One two", None), (2, "image", "a.png", "The cap & more"), (3, "text", "three", None), (4, "image", "b.png", "only alt"), (5, "text", "four", None), (6, "video", "v.mp4", None)]
    assert m.items_of(None) == m.items_of("") == []
    assert m.items_of("<p>broken <img src='x'")[0]["text"].startswith("broken")


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 3, b"x" * 64, "é".encode() * 5000])
def test_png_round_trip(raw):
    payload = m.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, len(raw)) and len(payload) < len(raw) + 65
    assert m.from_png(m.to_png(payload)) == payload


def test_png_filters():
    rows = [bytes((x * y + 7) % 256 for x in range(64)) for y in range(5)]
    body, before = b"", bytes(64)
    for kind, row in enumerate(rows):
        line = []
        for x in range(64):
            a, b, c = row[x - 1] if x else 0, before[x], before[x - 1] if x else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((row[x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        body, before = body + bytes([kind, *line]), row
    chunk = lambda n, d: struct.pack(">L", len(d)) + n + d + struct.pack(">L", zlib.crc32(n + d))
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2L5B", 64, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert m.from_png(image) == b"".join(rows)


def test_query_against_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in m.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        payload = m.padded(raw)
        g = got[d["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = m.to_png(payload)
        assert (g["media_bytes"], g["media_sha256"]) == (len(form), hashlib.sha256(form).hexdigest())
        assert g["position"] == 1 and g["caption"] == f"Text of {d['doc_id']} & its padding"


def test_unresolved_null_and_repeated(spark):
    scratch = Scratch(spark)
    stored = m.stored_payloads(spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id long, text string"), "text", scratch)
    digest = {r["id"]: r["digest"] for r in stored.collect()}
    facts = m.media_facts(stored.groupBy("digest").agg({"media": "max"}).toDF("digest", "media"))
    html = f'<img src="/{digest[1]}.png">a<img src="digest:{digest[3]}"><img src="{"0" * 64}"><img src="plain.png">'
    pages = m.interleaved(spark.createDataFrame([(1, html, 0), (1, html, 0), (2, None, 0), (3, "", 0)], "id long, html string, feature int"))
    rows = m.resolved_items(pages, facts).orderBy("item.position").collect()
    assert len(rows) == 10
    assert [r["payload_bytes"] for r in rows[::2]] == [64, None, 64, None, None]
    assert m.interleaved(spark.createDataFrame([], "html string")).collect() == []


def test_real_pages(spark):
    pages = m.interleaved(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    assert all(r["items"] for r in pages.filter("length(html) > 0").select("items").collect())


def test_captions_before_outside_and_never_closed():
    show = lambda html: [(i["kind"], i["text"] or i["reference"], i["caption"]) for i in m.items_of(html)]
    assert show("<figure><figcaption>Cap</figcaption><img src=a></figure>x") == [("image", "a", "Cap"), ("text", "x", None)]
    assert show("a<figcaption>alone</figcaption>b") == [("text", "a", None), ("text", "alone", None), ("text", "b", None)]
    assert show("<figure><img src=a><figcaption>open</figure>after") == [("image", "a", "open"), ("text", "after", None)]
    assert show("<figure><figcaption>no <p>media</p></figcaption></figure>z") == [("text", "no media", None), ("text", "z", None)]
    assert show("<figure><img src=a><figcaption>end") == [("image", "a", "end")]


def test_facts_and_items_with_clashing_names_and_odd_values(spark):
    scratch = Scratch(spark)
    long = "word " * 40_000
    rows = spark.createDataFrame([(1, long, "own"), (1, long, "own"), (None, None, None), (2, "", "own")], "id long, text string, feature string")
    stored = m.stored_payloads(rows.selectExpr("*", "'own' AS digest", "'own' AS media", "'own' AS n_bytes"), "text", scratch)
    assert len(stored.columns) == len(set(stored.columns)) == 5
    facts = m.media_facts(stored)
    assert facts.count() == 2 and facts.agg({"payload_bytes": "max"}).first()[0] == len(m.padded(long.encode()))
    pages = stored.selectExpr("id", "feature", "concat('<img src=', digest, '>') AS html", "'own' AS item", "'own' AS item_digest", "'own' AS payload_bytes")
    out = m.resolved_items(m.interleaved(pages), facts)
    assert len(out.columns) == len(set(out.columns)) and out.filter("payload_bytes > 0").count() == 4
    assert m.resolved_items(m.interleaved(pages), facts.limit(0)).filter("payload_bytes IS NULL").count() == 4
    assert m.media_facts(stored.limit(0)).collect() == []
