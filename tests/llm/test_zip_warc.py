import gzip
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import Row

from tesserae.llm import zip_warc as z
from tesserae.llm.common import Scratch


def rows_of(spark, data, schema="page_id long, url string, html string, extra int"):
    scratch = Scratch(spark)
    z.write_packages(spark.createDataFrame(data, schema), scratch.path("a"), scratch)
    return {r["record_key"]: r for r in z.resolved_facts(spark, scratch.path("a"), scratch).collect()}


def test_round_trip_and_revisits(spark):
    big = "é" * 700
    got = rows_of(spark, [(1, "u1", big, 0), (2, None, "x", 0), (3, "u3", big, 0), (4, "u\n4", None, 0), (5, "u", "x", 0), (None, "n", big, 0)])
    assert got["3"]["record_type"] == "response" and got["1"]["record_type"] == "revisit" and got["1"]["refers_to"] == "3"
    assert got["1"]["payload_bytes"] == 1400 and got["1"]["payload_digest"] == got["3"]["payload_digest"]
    assert got[None]["record_type"] == "revisit" and got["4"]["payload_bytes"] == 0
    assert got["2"]["record_type"] == got["5"]["record_type"] == "response" and got["2"]["url"] is None


def test_empty_table(spark):
    assert rows_of(spark, []) == {}


def test_ties_all_stay_responses(spark):
    scratch = Scratch(spark)
    z.write_packages(spark.createDataFrame([(1, "a", "y" * 2000), (1, "b", "y" * 2000)], "page_id long, url string, html string"), scratch.path("a"), scratch)
    assert [r["record_type"] for r in z.resolved_facts(spark, scratch.path("a"), scratch).collect()] == ["response"] * 2


def zip64(name: str, body: bytes) -> bytes:
    """A package whose every size and offset is in ZIP64 fields."""
    n = name.encode()
    local = struct.pack("<4s5H3L2H", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<2H2Q", 1, 16, len(body), len(body))
    entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(n), 28, 0, 0, 0, 0, 0xFFFFFFFF) + n + struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    start = len(local) + len(body)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    return local + body + entry + end64 + struct.pack("<4sLQL", b"PK\6\7", 0, start + len(entry), 1) + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64_directory():
    raw = zip64("archive/a.warc", b"hello")
    assert zipfile.ZipFile(io.BytesIO(raw)).read("archive/a.warc") == b"hello"  # the fixture itself is sound
    read_at = lambda o, n: raw[o : o + n]
    (member,) = z.central_directory(read_at, len(raw))
    at = z.data_offset(read_at, member)
    assert member["name"] == "archive/a.warc" and raw[at : at + member["stored"]] == b"hello"


def test_not_a_zip():
    with pytest.raises(ValueError):
        z.central_directory(lambda o, n: b"x" * n, 100)


@pytest.mark.parametrize("zipped", [True, False])
def test_archive_without_index(spark, tmp_path, zipped):
    records = [z.make_record(str(i), f"u{i}", b"p" * i * 40_000, "d", None)[2] for i in range(4)]
    body = b"".join(gzip.compress(r) if zipped else r for r in records)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as p:
        p.writestr("archive/x.warc" + ".gz" * zipped, body)
    index = z.read_index(z.list_packages(spark, str(tmp_path)))
    assert index.count() == 4
    one = z.read_records(index.filter("url = 'u3'")).collect()
    assert [len(r["payload"]) for r in one] == [120_000]
    assert isinstance(one[0], Row)


@pytest.mark.parametrize("cdxj", [False, True])
def test_one_of_two_archives_has_an_index(spark, tmp_path, cdxj):
    parts = {n: [gzip.compress(z.make_record(f"{n}{i}", f"u{n}{i}", b"p" * 50, "d", None)[2]) for i in range(3)] for n in "ab"}
    lines, at = [], 0
    for i, raw in enumerate(parts["a"]):
        where = {"offset": str(at), "length": str(len(raw)), "filename": "a.warc.gz"} if cdxj else {"offset": at, "length": len(raw), "member": "archive/a.warc.gz", "record_id": f"r{i}", "record_type": "response"}
        lines.append(("com,u)/ 20240101000000 " if cdxj else "") + json.dumps(where | {"url": f"ua{i}"}))
        at += len(raw)
    text = "\n".join(lines).encode()
    with zipfile.ZipFile(tmp_path / "p.wacz", "w") as out:
        for n in "ab":
            out.writestr(f"archive/{n}.warc.gz", b"".join(parts[n]))
        out.writestr("indexes/index.cdx.gz" if cdxj else "indexes/index.cdx", gzip.compress(text) if cdxj else text)
    index = z.read_index(z.list_packages(spark, str(tmp_path)))
    assert sorted(r["record_key"] for r in z.read_records(index).collect()) == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert sorted(r["url"] for r in index.collect()) == ["ua0", "ua1", "ua2", "ub0", "ub1", "ub2"]


def directory_of(raw):
    return z.central_directory(lambda o, n: raw[o : o + n], len(raw))


def test_end_record_inside_a_comment():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as p:
        p.writestr("archive/a.warc", b"x")
        p.comment = b"before PK\5\6" + b"\0" * 30
    assert [m["name"] for m in directory_of(held.getvalue())] == ["archive/a.warc"]


def test_as_many_members_as_fit_without_zip64():
    body = b"".join(struct.pack("<4s5H3L2H", b"PK\3\4", 20, 0, 0, 0, 0, 0, 0, 0, 1, 0) + b"n" for _ in range(1))
    entry = struct.pack("<4s6H3L5H2L", b"PK\1\2", 20, 20, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0) + b"n"
    raw = body + entry * 65_535 + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 65_535, 65_535, len(entry) * 65_535, len(body), 0)
    assert len(directory_of(raw)) == 65_535


@pytest.mark.parametrize("fault", ["compressed", "cut off"])
def test_what_cannot_be_read_whole_is_an_error(spark, tmp_path, fault):
    body = b"".join(gzip.compress(z.make_record(str(i), f"u{i}", b"p" * 900, "d", None)[2]) for i in range(3))
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as p:
        p.writestr("archive/x.warc.gz", body if fault == "compressed" else body[:-9], zipfile.ZIP_DEFLATED if fault == "compressed" else zipfile.ZIP_STORED)
    with pytest.raises(Exception, match=fault):
        z.read_index(z.list_packages(spark, str(tmp_path))).collect()


@pytest.mark.parametrize("hot", [1000, 3])
def test_revisits_of_hot_and_rare_responses(spark, monkeypatch, hot):
    monkeypatch.setattr(z, "HOT", hot)
    data = [(i, f"u{i}", "h" * 1500 if i < 40 else chr(97 + i % 5) * 2000, 0) for i in range(60)] + [(99, "own", "z" * 3000, 0)]
    got = rows_of(spark, data)
    assert len(got) == 61
    for i, _, html, _ in data:
        keeper = max(k for k, _, h, _ in data if h == html)
        r = got[str(i)]
        assert (r["record_type"], r["refers_to"], r["payload_bytes"]) == (("response", None, len(html)) if i == keeper else ("revisit", str(keeper), len(html)))


def records_of(spark, folder):
    return z.read_records(z.read_index(z.list_packages(spark, str(folder)))).collect()


def package(path, lines=None, **archives):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as p:
        for name, body in archives.items():
            p.writestr(f"archive/{name}.warc" + ".gz" * (body[:2] == b"\x1f\x8b"), body)
        if lines is not None:
            p.writestr("indexes/index.cdx", "\n".join(map(json.dumps, lines)))


def made(n, size=500):
    return [z.make_record(str(i), f"u{i}", bytes([97 + i % 26]) * (size + i), "d", None)[2] for i in range(n)]


@pytest.mark.parametrize("kept", [-200, -600, -5])
def test_plain_archive_that_is_cut_off(spark, tmp_path, kept):
    package(tmp_path / "x.wacz", x=b"".join(made(3))[:kept])
    with pytest.raises(Exception, match="cut off"):
        records_of(spark, tmp_path)


def test_plain_archive_without_its_last_blank_lines(spark, tmp_path):
    package(tmp_path / "x.wacz", x=b"".join(made(3))[:-4])
    assert sorted(len(r["payload"]) for r in records_of(spark, tmp_path)) == [500, 501, 502]


@pytest.mark.parametrize("n, size", [(3, 500), (400, 3000), (2, 3_000_000)])
def test_one_gzip_member_with_many_records(spark, tmp_path, n, size):
    package(tmp_path / "x.wacz", x=gzip.compress(b"".join(made(n, size))) + gzip.compress(z.make_record("own", "own", b"o", "d", None)[2]))
    got = {r["record_key"]: bytes(r["payload"]) for r in records_of(spark, tmp_path)}
    assert got == {str(i): bytes([97 + i % 26]) * (size + i) for i in range(n)} | {"own": b"o"}
    index = z.read_index(z.list_packages(spark, str(tmp_path)))
    assert [r["record_key"] for r in z.read_records(index.filter("url = 'u1'")).collect()] == ["1"]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("named", [[1], [0, 2], [0], [3, 4], []])
def test_index_that_names_some_records(spark, tmp_path, zipped, named):
    raws = [gzip.compress(r) if zipped else r for r in made(5)]
    at = [sum(map(len, raws[:i])) for i in range(5)]
    name = "archive/x.warc" + ".gz" * zipped
    # Lengths of a plain archive's lines may leave out the blank lines after a record.
    package(tmp_path / "x.wacz", [{"offset": at[i], "length": len(raws[i]) - 4 * (not zipped), "member": name} for i in named], x=b"".join(raws))
    assert sorted((r["record_key"], len(r["payload"])) for r in records_of(spark, tmp_path)) == [(str(i), 500 + i) for i in range(5)]


def test_index_lines_that_share_one_member(spark, tmp_path):
    raw = gzip.compress(b"".join(made(3)))
    package(tmp_path / "x.wacz", [{"offset": 0, "length": len(raw), "member": "archive/x.warc.gz", "url": f"u{i}", "record_id": f"r{i}", "record_type": "response"} for i in range(3)], x=raw)
    assert sorted(r["record_key"] for r in records_of(spark, tmp_path)) == ["0", "1", "2"]


def test_index_beyond_the_archive(spark, tmp_path):
    raws = [gzip.compress(r) for r in made(2)]
    package(tmp_path / "x.wacz", [{"offset": len(raws[0]), "length": len(raws[1]), "member": "archive/x.warc.gz"}], x=raws[0])
    with pytest.raises(Exception, match="cut off"):
        records_of(spark, tmp_path)


def test_keys_and_urls_come_back_as_they_were(spark):
    data = [("a\nb", " u\r\n1 ", "x"), ("50% é", "http://h/%20?a=é", "y"), (" ", None, "z"), (None, "", "n")]
    scratch = Scratch(spark)
    z.write_packages(spark.createDataFrame(data, "page_id string, url string, html string"), scratch.path("a"), scratch)
    got = z.read_records(z.read_index(z.list_packages(spark, scratch.path("a")))).collect()
    assert sorted(((r["record_key"], r["url"], bytes(r["payload"]).decode()) for r in got), key=str) == sorted(data, key=str)
