"""Token counts of flat token files by a scan for separators.

A flat file holds token ids one after another, each document followed by an end-of-document id,
and nothing says where documents begin. Files are cut into blocks; a block finds its separators
with one vectorised comparison and keeps their positions. A prefix scan over the small table of
blocks gives each block the number of separators before it (the ordinal of its first document)
and the last separator before it (where that document began).

A writer of such files is here too; it also notes which key has which ordinal in which file.

Defined cases: null and empty texts are documents of no tokens; documents without a separator
at the end of a file count as open ones; empty files have none; repeated rows are documents of
their own; an empty table writes no file and counts nothing; texts of any length are encoded whole;
only the key of the input is kept, so no name clashes. The end-of-document id must not
come out of the encoder (it is beyond its vocabulary).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, pieces, quoted
from .zip_warc import file_system

BLOCK = 4 << 20  # bytes
STEP = 1 << 20


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def id_type(eod: int) -> str:
    return "<u2" if eod < 1 << 16 else "<u4"


def write_flat(docs: DataFrame, folder: str, scratch: Scratch, *, ranks: str, pattern: str, eod: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One flat file for each partition; returns (key, file, ordinal)."""
    rows = docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, codec = TaskContext.get(), encoder(ranks, pattern)
        files, root = file_system(folder)
        files.create_dir(root, recursive=True)
        name = f"tokens-{task.partitionId():06d}.bin"
        part = f"{root}/.{name}-{task.taskAttemptId()}"
        done = 0
        with files.open_output_stream(part) as out:
            for batch in batches:
                for piece in pieces(batch, "text", STEP):
                    texts = piece.column(1).to_pylist()
                    for text in texts:
                        ids = codec.encode_ordinary(text) if text else []
                        ids.append(eod)
                        out.write(np.array(ids, dtype=id_type(eod)).tobytes())
                    yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([name] * len(texts)), pa.array(np.arange(done, done + len(texts)))], names=["key", "file", "ordinal"])
                    done += len(texts)
        if done:
            files.move(part, f"{root}/{name}")
        else:
            files.delete_file(part)

    schema = T.StructType([rows.schema["key"], T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType())])
    return scratch.keep(rows.mapInArrow(write, schema), "order")


def list_flat(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def count_documents(files: DataFrame, eod: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(path, length) to one row for each document: path, ordinal, start (in tokens), n_tokens
    without the separator, closed (false for tokens after the last separator)."""
    width = np.dtype(id_type(eod)).itemsize
    step = max(width, block // width * width)
    blocks = files.filter(F.col("length") >= width).select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - width) / step).cast("long"))).alias("block", "n"))
    blocks = blocks.select("path", "block", (F.col("n") * step).alias("at"), F.least(F.lit(step).cast("long"), F.col("length") - F.col("n") * step).alias("size"))
    parts = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    blocks = blocks.repartition(parts, "path", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, at, size in zip(*[c.to_pylist() for c in batch.columns]):
                store, where = file_system(path)
                with store.open_input_file(where) as source:
                    ids = np.frombuffer(source.read_at(size // width * width, at), dtype=id_type(eod))
                ends = np.flatnonzero(ids == eod) + at // width
                offsets = pa.array([0, ends.size], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([number], pa.int32()), pa.array([at // width + ids.size], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ends, pa.int64()))], names=["path", "block", "stop", "ends"])

    found = scratch.keep(blocks.mapInArrow(scan, "path string, block int, stop long, ends array<long>"), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("path", "block", F.size("ends").cast("long").alias("n"), F.get("ends", F.size("ends") - 1).alias("last"))
    carried = small.select(F.col("path").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    joined = found.join(carried, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    closed = joined.select("path", "first", "carry", "ends", F.posexplode("ends").alias("i", "stop"))
    begin = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    closed = closed.select("path", (F.col("first") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("stop") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("path").agg(F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.get("ends", F.size("ends") - 1)), F.lit(-1)).alias("carry"), F.max("stop").alias("stop")).filter("stop > carry + 1")
    tails = tails.select("path", "ordinal", (F.col("carry") + 1).alias("start"), (F.col("stop") - F.col("carry") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch, eod = Scratch(spark), 50256
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    order = write_flat(docs, scratch.path("flat"), scratch, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN, eod=eod)
    counts = count_documents(list_flat(spark, scratch.path("flat")), eod, scratch)
    named = counts.select(F.element_at(F.split("path", "/"), -1).alias("f"), F.col("ordinal").alias("o"), "start", "n_tokens")
    return order.join(named, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select(F.col("key").alias("doc_id"), "file", "ordinal", "start", "n_tokens")
