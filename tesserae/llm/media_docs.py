"""Interleaved documents of text and media, with payloads stored once by digest.

HTML becomes an ordered list of items: text runs, and media references with their caption
(figcaption, else alt, else title; a figcaption is that of all media of its figure, before or after
it, and text where it has none). References name payloads by digest. The store is a table (digest, media); a task writes a form once however often it meets it. Features come
from the stored bytes, where they lie; only their small rows are grouped by digest, and a
reference resolves by a join on its digest. Items keep their positions and captions whether or
not they resolve.

Payloads are kept losslessly as 8-bit grey PNG images, 64 samples wide, made and read here.

Defined cases: null or empty HTML has no items; references that resolve to nothing have null
payload columns; several references to one payload share it; repeated rows keep an item list
each; an empty table gives an empty result; outputs replace input columns of their name; a page or
payload of any length is parsed and stored whole, one at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import ship

from .common import Scratch, pieces, quoted, with_outputs

WIDTH = 64
STEP = 1 << 20
#: Digests a writing task remembers.
MET = 500_000
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("reference", T.StringType()), T.StructField("caption", T.StringType())])
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": None, "embed": "embed"}
_HIDDEN = {"script", "style", "template", "noscript"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "header", "footer", "blockquote", "pre", "title"}


# --- HTML ----------------------------------------------------------------------------------


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.figure_caption: str | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self._add("text", text, None, None)

    def _add(self, kind, text, reference, caption) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "reference": reference, "caption": caption})

    def handle_starttag(self, tag, attrs) -> None:
        own = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA:
            self.end_text()
            reference = own.get("src") or own.get("data-src")
            if reference:
                kind = _MEDIA[tag] or "source"
                self._add(kind, None, reference.strip(), own.get("alt") or own.get("title") or None)
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in _BREAKS:
            if tag in ("figure", "figcaption"):
                self.end_caption()
            if self.caption is not None:
                self.caption.append(" ")
                return
            self.end_text()
            if tag == "figure":
                self.end_figure()
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BREAKS:
            if tag == "figure":
                self.end_caption()
                self.end_figure()
            if self.caption is None:
                self.end_text()

    def end_caption(self) -> None:
        """The open caption, if any, is kept for its figure; outside a figure it is text."""
        if self.caption is None:
            return
        caption = " ".join("".join(self.caption).split())
        self.caption = None
        if self.figure is not None:
            self.figure_caption = " ".join(x for x in (self.figure_caption, caption) if x)
        elif caption:
            self._add("text", caption, None, None)

    def end_figure(self) -> None:
        caption, media = self.figure_caption, self.figure
        self.figure = self.figure_caption = None
        for i in media or []:
            self.items[i]["caption"] = caption or self.items[i]["caption"]
        if caption and not media:
            self.end_text()
            self._add("text", caption, None, None)

    def handle_data(self, data) -> None:
        if self.hidden:
            return
        (self.words if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    if not html:
        return []
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.end_caption()
    parser.end_text()
    parser.end_figure()
    return parser.items


def interleaved(pages: DataFrame, *, html: str = "html", items: str = "items") -> DataFrame:
    """pages with the ordered items of the HTML, array<struct>."""
    ship(pages.sparkSession)
    packed = pages.select(F.struct(*[quoted(c) for c in pages.columns if c.lower() != items.lower()], F.lit(0).alias("__tsr")).alias("row"), quoted(html).cast("string").alias("__html"))
    arrow = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__html", STEP):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([items_of(x) for x in part.column(1).to_pylist()], arrow)], names=["row", "items"])

    schema = T.StructType([packed.schema["row"], T.StructField("items", T.ArrayType(ITEM))])
    return packed.mapInArrow(parse, schema).select("row.*", F.col("items").alias(items)).drop("__tsr")


# --- payloads ------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of WIDTH."""
    return raw + b"\0" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of rows of WIDTH samples; payload is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    chunk = lambda name, body: struct.pack(">L", len(body)) + name + body + struct.pack(">L", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2L5B", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 5)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an 8-bit grey image without interlace, whatever row filters it uses."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, width = 8, [], 0
    while at < len(image):
        size, name = struct.unpack(">L4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack(">L", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        if name == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">2L5B", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("not 8-bit grey")
        elif name == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:].tobytes()
    out = np.zeros((height + 1, width + 1), dtype=np.int64)  # a zero row above and column before
    for y in range(height):
        kind, row, up = lines[y, 0], lines[y, 1:].astype(np.int64), out[y]
        for x in range(width):
            a, b, c = out[y + 1, x], up[x + 1], up[x]
            if kind == 4:
                p = a + b - c
                guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                guess = (0, a, b, (a + b) // 2)[kind]
            out[y + 1, x + 1] = (row[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).tobytes()


def feature_of(payload: bytes) -> str:
    """Means of an 8 by 8 grid over the image's rows and columns, as hexadecimal bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH).astype(np.float64)
    edges = np.linspace(0, len(rows), 9).astype(int)
    grid = [rows[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) if a < len(rows) else np.zeros(8) for a, b in zip(edges, edges[1:])]
    return np.rint(np.array(grid)).astype(np.uint8).tobytes().hex()


# --- store and join ------------------------------------------------------------------------


def stored_payloads(rows: DataFrame, payload: str, scratch: Scratch, name: str = "payloads") -> DataFrame:
    """rows with n_bytes, the digest (SHA-256) of the stored form of the payload column and that form
    as media, where its task met it first (else null), written to the shared folder."""
    given = [c for c in rows.columns if c != payload and c.lower() not in ("n_bytes", "digest", "media")]
    packed = rows.select(F.struct(*[quoted(c) for c in given], F.lit(0).alias("__tsr")).alias("row"), quoted(payload).cast("binary").alias("body"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[str] = set()
        for batch in batches:
            for part in pieces(batch, "body", STEP):
                raw = [x or b"" for x in part.column(1).to_pylist()]
                forms = [to_png(padded(x)) for x in raw]
                digests = [hashlib.sha256(x).hexdigest() for x in forms]
                if len(met) > MET:
                    met.clear()
                first = [d not in met and not met.add(d) for d in digests]
                media = [x if new else None for x, new in zip(forms, first)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(digests), pa.array(media, pa.binary())], names=["row", "n_bytes", "digest", "media"])

    schema = T.StructType([packed.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])
    return scratch.keep(packed.mapInArrow(store, schema).select("row.*", "n_bytes", "digest", "media").drop("__tsr"), name)


FACTS = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "media", STEP):
            media = part.column(1).to_pylist()
            raw = [from_png(x) for x in media]
            columns = [part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([zlib.crc32(x[-64:]) for x in raw], pa.int64()),
                       pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array([feature_of(x) for x in raw])]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FACTS.split(", ")])


def media_facts(store: DataFrame) -> DataFrame:
    """Facts and features of a store (digest, media), from the bytes it holds; one row a digest."""
    facts = store.filter("media IS NOT NULL").select("digest", "media").mapInArrow(_facts, FACTS)
    return facts.groupBy("digest").agg(*[F.max(c).alias(c) for c in facts.columns if c != "digest"])


def resolved_items(pages: DataFrame, facts: DataFrame, items: str = "items") -> DataFrame:
    """One row for each item of each page, media items with the facts of their payload: the
    digest is the part of the reference after the last of / and :, before an extension."""
    rows = pages.select("*", F.explode(quoted(items)).alias("__tsr_item"))
    digest = F.regexp_extract("__tsr_item.reference", r"([0-9a-f]{64})(\.[A-Za-z0-9]+)?$", 1)
    rows = with_outputs(rows, {"item": F.col("__tsr_item"), "item_digest": F.when(digest != "", digest)}).drop("__tsr_item", items)
    names = [c for c in facts.columns if c != "digest"]
    kept = facts.select(F.col("digest").alias("__tsr_d"), *[F.col(c).alias(f"__tsr_{c}") for c in names])
    joined = rows.join(kept, F.col("item_digest") == F.col("__tsr_d"), "left")
    return with_outputs(joined, {c: F.col(f"__tsr_{c}") for c in names}).drop("__tsr_d", *[f"__tsr_{c}" for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """Each document becomes a page: a heading, its whole text as a media payload in a figure, and
    a closing line; the page is parsed and its figure resolved again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = stored_payloads(docs, "text", scratch)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    page = F.concat(F.lit("<article><h1>Document "), name, F.lit("</h1><figure><img src=\"media/"), F.col("digest"), F.lit(".png\" alt=\"\"><figcaption>Text of "), name, F.lit(" &amp; its padding</figcaption></figure><p>End.</p></article>"))
    pages = interleaved(stored.select("doc_id", "n_bytes", page.alias("html")))
    facts = scratch.keep(media_facts(stored), "facts")
    items = resolved_items(pages.drop("html"), facts).filter("item.kind = 'image'")
    return items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.col("item.position").alias("position"), F.col("item.caption").alias("caption"))
