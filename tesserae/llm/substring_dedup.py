"""Removal of repeated passages by hashing units.

A unit is a line or a clause of one: lines are cut after punctuation too, because passages are
copied into the middle of lines. Units are normalised (lower case, white space folded), digested
to 64 bits and grouped over the whole corpus. The earliest occurrence, by key, then text
hash, then position, stays; every other occurrence is marked. Marked units that follow each
other make a run, and runs of at least `min_words` words are removed; with `min_words=1` every
marked unit goes. Spans are offsets in characters of the original text.

What repeats inside a text is found where the text is cut, so only one occurrence of a digest for
each text meets the corpus: its row is the text's key and hash, its place and its digest. The
places that come back mark the text, which is cut once more to remove them.

Defined cases: null and empty texts have no units and come back as they are; null keys rank
last; rows that repeat key and text are one document and are treated alike; an empty table
gives an empty result; outputs replace input columns of their name; a text of any length is cut
whole, in one piece. A passage whose first or last clause is joined to other words keeps that part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pieces, quoted, with_outputs

#: Where units end: after a line feed, or before white space that follows punctuation and up to
#: four more signs.
CUT = re.compile(r"\n|[.!?,;:][^\s]{0,4}(?=[ \t])")
MIN_WORDS = 20
REMOVED = "array<struct<start:int,stop:int,words:int>>"


def cut_units(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, words, digest) of each unit that has words, in order."""
    start = 0
    for stop in [m.end() for m in CUT.finditer(text)] + [len(text)]:
        words = text[start:stop].lower().split()
        if words:
            yield start, stop, len(words), xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
        start = stop


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, h, p, digest): of each text's units with one digest the first, by its place."""
    for batch in batches:
        for part in pieces(batch, "t", 1 << 20):
            sizes, places, digests = [], [], []
            for text in part.column(2).to_pylist():
                first: dict[int, int] = {}
                for i, (_, _, _, d) in enumerate(cut_units(text)):
                    first.setdefault(d, i)
                sizes.append(len(first))
                places.append(np.fromiter(first.values(), dtype=np.int32, count=len(first)))
                digests.append(np.fromiter(first, dtype=np.uint64, count=len(first)).view(np.int64))
            of = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(np.concatenate(places)), pa.array(np.concatenate(digests))], names=["k", "h", "p", "digest"])


def marked_places(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(k, h, places): for each document with any, the places of its units (the first of each digest)
    that an earlier document has too."""
    rows = docs.filter(quoted(text).isNotNull()).select(quoted(key).alias("k"), F.xxhash64(quoted(text)).alias("h"), quoted(text).cast("string").alias("t"))
    long = T.LongType()
    schema = T.StructType([rows.schema["k"], T.StructField("h", long), T.StructField("p", T.IntegerType()), T.StructField("digest", long)])
    units = scratch.keep(rows.mapInArrow(_units, schema), "units")
    owner = F.struct(F.col("k").isNull().alias("last"), "k", "h")
    firsts = units.groupBy("digest").agg(F.min(owner).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = scratch.keep(firsts.select(F.col("digest").alias("d"), "first"), "firsts")
    # Both sides are read afresh, so that adaptive execution can split a digest with many units.
    later = units.join(firsts, F.col("digest") == F.col("d")).filter(~owner.eqNullSafe(F.col("first")))
    # Sets, because rows that repeat key and text bring the same places: a set is bounded by its text.
    marked = scratch.keep(later.groupBy("k", "h").agg(F.collect_set("p").alias("places")), "marked")
    scratch.drop("units")
    scratch.drop("firsts")
    return marked


def cut_text(text: str, places: list[int] | None, min_words: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without its runs of later units, and the runs as (start, stop, words)."""
    found = list(cut_units(text))
    digests = [d for *_, d in found]
    if not places and len(set(digests)) == len(digests):
        return text, []
    gone = {digests[p] for p in places or ()}
    seen: set[int] = set()
    runs: list[tuple[int, int, int]] = []
    last = -2  # place of the unit that the last run ends with
    for i, (start, stop, words, d) in enumerate(found):
        if d in gone or d in seen:
            if last == i - 1:
                runs[-1] = (runs[-1][0], stop, runs[-1][2] + words)
            else:
                runs.append((start, stop, words))
            last = i
        seen.add(d)
    runs = [r for r in runs if r[2] >= min_words]
    edges = [0, *[x for r in runs for x in r[:2]], len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def _cut(min_words: int):
    kind = pa.struct([("clean_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())])))])

    def cut(text: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for part in pieces(pa.RecordBatch.from_arrays([text, places], names=["t", "p"]), "t", 1 << 20):
            made = [(None, []) if t is None else cut_text(t, p, min_words) for t, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            out.append(pa.array([{"clean_text": t, "removed": [dict(zip(("start", "stop", "words"), r)) for r in runs]} for t, runs in made], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return F.arrow_udf(cut, f"clean_text string, removed {REMOVED}")


def dedup_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """docs with clean_text (null for a null text) and removed, array<struct<start,stop,words>>."""
    scratch = scratch or Scratch(docs.sparkSession)
    marked = marked_places(docs, key, text, scratch)
    marked = marked.select(F.col("k").alias("__tsr_k"), F.col("h").alias("__tsr_h"), F.col("places").alias("__tsr_p"))
    # A sorted merge at every size: texts move once, places are never broadcast.
    joined = docs.hint("merge").join(marked, quoted(key).eqNullSafe(F.col("__tsr_k")) & (F.xxhash64(quoted(text)) == F.col("__tsr_h")), "left")
    made = joined.withColumn("__tsr_cut", _cut(min_words)(quoted(text).cast("string"), F.col("__tsr_p")))
    out = with_outputs(made, {"clean_text": F.col("__tsr_cut.clean_text"), "removed": F.col("__tsr_cut.removed")})
    return out.drop("__tsr_k", "__tsr_h", "__tsr_p", "__tsr_cut")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_passages(docs).select("doc_id", F.col("clean_text").alias("text"), "removed")
