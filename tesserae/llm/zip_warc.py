"""WARC records inside ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file with stored (uncompressed) members: `archive/*.warc.gz`, whose records
are gzip members of their own, and `indexes/index.cdx` with one line for each record. The
reader parses the end record, the ZIP64 end record and the central directory from the file's
tail, finds each stored member's data through its local header, and reads records by byte
range. What no index line covers, a whole archive or the gaps between its lines, is scanned once,
record by record. Indexes may be gzipped, and their lines CDXJ (key, time, JSON). A gzip member that
holds several records has one byte range: its records are cut from it where they start, and one
task unzips it, as a stream.

Files are opened with pyarrow.fs (file, hdfs, s3, gs); listings come from Spark.

Defined cases: a null payload is written as an empty one; null keys and urls come back null;
equal payloads of `min_revisit` bytes or more keep the row with the largest key as response
(null is the smallest; rows that tie for it all stay responses) and the others are revisits;
an empty table makes no archive and reads as no rows; other input columns, whatever their names,
are not stored; a payload of any length is one record, which the task that writes or reads it holds
whole. Keys and urls come back as they were, line feeds and blanks included. An archive that is
compressed inside its package or cut off is an error, never a part of it; so is a record without a length.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship

from .common import Scratch, quoted

DATE = "2024-01-01T00:00:00Z"
#: Records that lie this close together are fetched by one range read.
SPAN = 8 << 20
#: A response is hot if over a HOT-th of all revisits refer to it; the tasks that a hot one is dealt to.
HOT, SALTS = 1000, 64
#: Bytes of payload after which a batch of read records is sent on.
BATCH = 4 << 20
#: Bytes of an archive that a scan reads at once.
STEP = 1 << 16

#: inner: where the record starts in its unzipped gzip member, null if the byte range is the record's alone.
INDEX_TYPES = "path string, member string, offset long, length long, inner long, record_id string, record_type string, url string"
RECORD_TYPES = "record_key string, url string, record_id string, record_type string, digest string, refers_to string, payload binary"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# --- records -------------------------------------------------------------------------------


def make_record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: tuple | None) -> tuple[str, str, bytes]:
    """(record id, type, bytes). refers_to is (key, digest) of the response of a revisit."""
    name = lambda k, d: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{k}|{d}')}"
    kind = "revisit" if refers_to else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(key, digest)}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        header = url.replace("\r", "%0D").replace("\n", "%0A").strip()
        lines.append(f"WARC-Target-URI: {header}")
        if header != url:
            lines.append(f"X-Record-Url: {quote(url)}")
    if key is not None:
        lines.append(f"X-Record-Key: {quote(key)}")
    if refers_to:
        lines += [f"WARC-Refers-To: <{name(*refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name(key, digest), kind, "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    http = "application/http" in fields.get("content-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    bare = lambda x: x.strip("<>") if x else None
    kind = fields.get("warc-type")
    own = {name: unquote(fields[name]) for name in ("x-record-key", "x-record-url") if name in fields}
    return {
        "record_key": own.get("x-record-key"), "url": own.get("x-record-url", fields.get("warc-target-uri")), "record_id": bare(fields.get("warc-record-id")), "record_type": kind,
        "digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None, "refers_to": bare(fields.get("warc-refers-to")), "payload": None if kind == "revisit" else payload,
    }


# --- ZIP -----------------------------------------------------------------------------------


def central_directory(read_at, size: int) -> list[dict]:
    """Members of a ZIP file from its central directory, ZIP64 included.

    read_at(offset, length) gives bytes. Each member: name, method, size, stored, header.
    """
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # the signature may stand inside the comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start = struct.unpack("<4H2L", tail[at + 4 : at + 20])
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        locator = tail[at - 20 : at] if at >= 20 else read_at(tail_at + at - 20, 20)
        if locator[:4] == b"PK\6\7":
            (where,) = struct.unpack("<Q", locator[8:16])
            end = read_at(where, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack("<3Q", end[32:56])
        elif 0xFFFFFFFF in (length, start):  # 65,535 members alone need no ZIP64
            raise ValueError("no ZIP64 locator")
    directory, at, out = read_at(start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, stored, full, n_name, n_extra, n_note, header = struct.unpack("<10xH8x2L3H8xL", directory[at : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<2H", extra[:4])
            if tag == 1:  # ZIP64: only the fields that overflowed, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        out.append({"name": name, "method": method, "size": full, "stored": stored, "header": header})
        at += 46 + n_name + n_extra + n_note
    return out


def data_offset(read_at, member: dict) -> int:
    head = read_at(member["header"], 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack("<2H", head[26:30])
    return member["header"] + 30 + n_name + n_extra


def _record_size(held: bytearray) -> tuple[int, int] | None:
    """(bytes to the end of the first record's block, with the blank lines after it), once its head is there."""
    head = held.find(b"\r\n\r\n")
    if head < 0:
        return None
    sizes = [int(x.split(b":")[1]) for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise ValueError("a record's head has no single length; the archive is broken or cut off")
    return head + 4 + sizes[0], head + 4 + sizes[0] + 4


class _Cutter:
    """Cuts a stream of bytes into records; holds one record at a time."""

    def __init__(self):
        self.held, self.at, self.need = bytearray(), 0, None

    def _leave(self, n: int) -> None:
        del self.held[:n]
        self.at, self.need = self.at + n, None

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, bytes) of the records that data completes; all of them if it is the last."""
        self.held += data
        while self.held:
            if self.need is None:
                first = self.held[:64]
                blank = len(first) - len(first.lstrip(b"\r\n"))
                if blank:
                    self._leave(blank)
                    continue
                self.need = _record_size(self.held)
            if self.need is not None and (len(self.held) >= self.need[1] or last and len(self.held) >= self.need[0]):
                n = min(self.need[1], len(self.held))
                yield self.at, n, bytes(self.held[:n])
                self._leave(n)
            elif last:
                raise ValueError(f"the archive's record at byte {self.at} is cut off")
            else:
                return


def _member_records(chunk: bytes, more: Callable[[], bytes]) -> Iterator[tuple[int, int, bytes] | tuple[int, bytes]]:
    """Records of one gzip member that starts with chunk, as a _Cutter gives them; at last the
    member's length and what was read beyond it. more() reads on."""
    unzip, cut, used = zlib.decompressobj(31), _Cutter(), 0
    while True:
        if not chunk:
            raise ValueError("the archive's last gzip member is cut off")
        used += len(chunk)
        data = unzip.decompress(chunk, STEP << 4)  # in parts: runs of one byte unzip a thousandfold
        while True:
            yield from cut.feed(data, unzip.eof)
            if unzip.eof or not (unzip.unconsumed_tail or data):
                break
            data = unzip.decompress(unzip.unconsumed_tail, STEP << 4)
        if unzip.eof:
            yield used - len(unzip.unused_data), unzip.unused_data
            return
        chunk = more()


def _reader(read_at, start: int, size: int) -> Callable[[], bytes]:
    """Reads a byte range step by step."""
    at = 0

    def more() -> bytes:
        nonlocal at
        data = read_at(start + at, min(STEP, size - at))
        at += len(data)
        return data

    return more


def scan_records(read_at, start: int, size: int, zipped: bool) -> Iterator[tuple[int, int, int | None, dict]]:
    """(offset, length, inner, facts) of every record of a byte range that has no index, read in steps."""
    facts = lambda raw: {k: v for k, v in parse_record(raw).items() if k in ("record_id", "record_type", "url")}
    more = _reader(read_at, start, size)
    if not zipped:
        cut, seen = _Cutter(), 0
        while seen < size:
            data = more()
            if not data:
                raise ValueError("the archive is cut off")
            seen += len(data)
            for at, length, raw in cut.feed(data, seen == size):
                yield at, length, None, facts(raw)
        return
    at, left = 0, b""
    while at < size:
        found = []
        for x in _member_records(left or more(), more):
            if len(x) == 3:
                found.append((x[0], facts(x[2])))
            else:
                length, left = x
        for inner, fact in found:
            yield at, length, inner if len(found) > 1 else None, fact
        at += length


# --- writer --------------------------------------------------------------------------------


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        final = f"{root}/part-{task.partitionId():06d}.wacz"
        part = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        index, count = io.StringIO(), 0
        rows = (row for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        with files.open_output_stream(part) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
            with package.open("archive/data.warc.gz", "w", force_zip64=True) as member:
                at, row = 0, first
                while row is not None:
                    payload = row["payload"] or b""
                    refers = (row["refers_to"], row["digest"]) if row["revisit"] else None
                    name, kind, raw = make_record(row["record_key"], row["url"], payload, row["digest"], refers)
                    zipped = gzip.compress(raw, compresslevel=4, mtime=0)
                    member.write(zipped)
                    index.write(json.dumps({"offset": at, "length": len(zipped), "record_id": name, "record_type": kind, "url": row["url"]}) + "\n")
                    at, count, row = at + len(zipped), count + 1, next(rows, None)
            package.writestr("indexes/index.cdx", index.getvalue())
            package.writestr("datapackage.json", json.dumps({"profile": "data-package", "records": count}))
        files.move(part, final)
        yield pa.RecordBatch.from_pydict({"path": [final], "records": [count]})

    return write


def write_packages(pages: DataFrame, folder: str, scratch: Scratch, *, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Writes one package for each partition and returns (path, records)."""
    body = F.coalesce(quoted(payload).cast("binary"), F.lit(b""))
    rows = pages.select(quoted(key).alias("id"), quoted(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    equal = rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "keeper")
    equal = scratch.keep(equal, "equal")
    # A sorted merge at every size: repeated digests grow with the pages and are never broadcast.
    rows = rows.join(equal.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    rows = rows.select(F.col("id").cast("string").alias("record_key"), "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", revisit.alias("revisit"), F.col("keeper").cast("string").alias("refers_to"))
    return scratch.keep(rows.mapInArrow(_writer(folder), "path string, records long"), "packages")


# --- reader --------------------------------------------------------------------------------


def list_packages(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def _names(line: dict, archive: str) -> bool:
    """Whether an index line is of this archive: `member` is its path, CDXJ's `filename` may be the end of it."""
    if "member" not in line and "filename" in line:
        return archive == line["filename"] or archive.endswith("/" + line["filename"])
    return line.get("member", "archive/data.warc.gz") == archive


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string())])
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, at = file_system(path)
            with files.open_input_file(at) as source:
                read_at = lambda offset, length: source.read_at(length, offset)
                members = central_directory(read_at, size)
                archives = {m["name"]: (data_offset(read_at, m), m) for m in members if m["name"].endswith((".warc.gz", ".warc"))}
                if packed := [name for name, (_, m) in archives.items() if m["method"] != 0]:
                    raise ValueError(f"{path}: {packed[0]} is compressed inside the package; its records have no byte ranges")
                lines = []
                for m in (m for m in members if m["name"].startswith("indexes/")):
                    raw = read_at(data_offset(read_at, m), m["stored"])
                    raw = raw if m["method"] == 0 else zlib.decompress(raw, -15)
                    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                    lines += [json.loads(x[x.index(b"{") :]) for x in raw.splitlines() if b"{" in x and not x.startswith(b"!")]
                out = []
                for name, (start, m) in archives.items():
                    zipped = name.endswith(".gz")
                    named = [x | {"offset": int(x["offset"]), "length": int(x["length"])} for x in lines if _names(x, name) and "offset" in x and "length" in x]
                    found = {x["offset"]: x for x in named}
                    if any(found[x["offset"]] != x for x in named):
                        found = {}  # several records of one byte range: the scan tells them apart
                    done, gaps = 0, []
                    for x in sorted(found.values(), key=lambda x: x["offset"]):
                        if x["offset"] + x["length"] > m["size"]:
                            raise ValueError(f"{path}: {name} is cut off: its index names byte {x['offset'] + x['length']} of {m['size']}")
                        if not {"record_id", "record_type", "url"} <= x.keys():  # CDXJ has not all of them
                            raw = read_at(start + x["offset"], x["length"])
                            found[x["offset"]] = parse_record(zlib.decompress(raw, 31) if zipped else raw) | {"offset": x["offset"], "length": x["length"]}
                        if x["offset"] > done:
                            gaps.append((done, x["offset"]))
                        done = max(done, x["offset"] + x["length"])
                    every = [x | {"inner": None} for x in found.values()]
                    for a, b in [*gaps, *([(done, m["size"])] if done < m["size"] else [])]:
                        every += [{"offset": a + o, "length": n, "inner": k} | fact for o, n, k, fact in scan_records(read_at, start + a, b - a, zipped)]
                    out += [{"path": path, "member": name, "offset": start + x["offset"], **{k: x[k] for k in ("length", "inner", "record_id", "record_type", "url")}} for x in every]
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=schema)


def read_index(packages: DataFrame) -> DataFrame:
    """(path, length) of packages to one row for each record, with its byte range in the file."""
    return packages.repartition(F.col("path")).mapInArrow(_index, INDEX_TYPES)


def _alone(source, rows: list[tuple]) -> Iterator[bytes]:
    """Records that have byte ranges of their own, side by side: one range read."""
    base = rows[0][2]
    raw = source.read_at(rows[-1][2] + rows[-1][3] - base, base)
    for _, member, offset, length, _ in rows:
        piece = raw[offset - base : offset - base + length]
        yield zlib.decompress(piece, 31) if member.endswith(".gz") else piece


def _shared(source, rows: list[tuple]) -> Iterator[bytes]:
    """The wanted records of one gzip member, which is unzipped as a stream."""
    wanted = {row[4] for row in rows}
    more = _reader(lambda offset, length: source.read_at(length, offset), rows[0][2], rows[0][3])
    for x in _member_records(more(), more):
        if len(x) == 3 and x[0] in wanted:
            yield x[2]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x, pa.string()) for x in ("record_key", "url", "record_id", "record_type", "digest", "refers_to")] + [("payload", pa.binary())])
    path, source = None, None
    for batch in batches:
        rows = list(zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "member", "offset", "length", "inner")]))
        i = 0
        while i < len(rows):
            j = i + 1
            shared = rows[i][4] is not None
            while j < len(rows) and shared and rows[j][:3] == rows[i][:3]:
                j += 1
            while j < len(rows) and not shared and rows[j][4] is None and rows[j][0] == rows[i][0] and rows[j][2] == rows[j - 1][2] + rows[j - 1][3] and rows[j][2] + rows[j][3] - rows[i][2] <= SPAN:
                j += 1
            if rows[i][0] != path:
                path = rows[i][0]
                files, at = file_system(path)
                source = files.open_input_file(at)
            out, held = [], 0
            for piece in _shared(source, rows[i:j]) if shared else _alone(source, rows[i:j]):
                out.append(parse_record(piece))
                held += len(out[-1]["payload"] or b"")
                if held > BATCH:  # a span unzips to several times its size
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
            i = j


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index, or of any part of it, by range reads; revisits have no payload."""
    dealt = index.repartition("path", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("path", "offset", "inner")
    return dealt.mapInArrow(_records, RECORD_TYPES)


def resolved(records: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Facts of every record, a revisit's taken from the response it refers to.

    Records are read once and their facts written. Only revisits are joined, and revisits of a
    response to which over a HOT-th of them refer, of which there are fewer than HOT, are dealt to
    SALTS tasks."""
    scratch = scratch or Scratch(records.sparkSession)
    facts = records.select("record_key", "url", "record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    facts = scratch.keep(facts, "record-facts")
    revisits = facts.filter("refers_to IS NOT NULL")
    referred = revisits.groupBy(F.col("refers_to").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.keep(referred.filter(F.col("n") * HOT > revisits.count()).select("id"), "hot")
    salt = F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("record_id", "record_key"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = revisits.join(F.broadcast(hot), F.col("refers_to") == F.col("id"), "left").withColumn("salt", salt).drop("id")
    responses = facts.filter("record_type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("r_id")).agg(F.max("record_key").alias("r_key"), F.max("payload_bytes").alias("r_bytes"), F.max("payload_digest").alias("r_digest"))
    each = F.when(F.col("id").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    responses = responses.join(F.broadcast(hot), F.col("r_id") == F.col("id"), "left").withColumn("r_salt", F.explode(each)).drop("id")
    # Sorted: what Spark reckons of records comes from the listing of files and says nothing of their number.
    joined = dealt.join(responses.hint("merge"), (F.col("refers_to") == F.col("r_id")) & (F.col("salt") == F.col("r_salt")), "left")
    joined = joined.select("record_key", "url", "record_type", F.coalesce("payload_bytes", "r_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "r_digest").alias("payload_digest"), F.col("r_key").alias("refers_to"))
    return facts.filter("refers_to IS NULL").select(*joined.columns).union(joined)


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::bigint AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch.path("archives")
    write_packages(pages, folder, scratch)
    facts = scratch.keep(resolved_facts(spark, folder, scratch), "facts")
    return facts.select(F.col("record_key").cast("long").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def resolved_facts(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    packages = scratch.spark.read.parquet(scratch.path("packages"))
    if not packages.head(1):
        return resolved(spark.createDataFrame([], RECORD_TYPES), scratch)
    records = read_records(read_index(list_packages(spark, folder)))
    return resolved(records, scratch)
