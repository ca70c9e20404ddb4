"""What the corpus operators share: the scratch folder, row packing and streamed groups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship

#: The white space that separates words everywhere in this subpackage: space and \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's settings of an Arrow batch's bytes, and that a query's shuffle files go when it ends.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's
    checkpoint folder, else (local tests only) a new temporary folder."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB, unless the session names a size of its own: by Spark's default a
    batch is 10,000 rows up to 64 MB, which a worker and its JVM hold several times over."""
    if spark.conf.get(BATCH_BYTES) in BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


_made: list[list[Scratch]] = []


@contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes every Scratch made inside when the block ends. What is still read from must have been
    written elsewhere by then."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.drop()


class Scratch:
    """Tables in a folder of their own in the shared folder. A lost executor loses nothing
    that was kept here. drop() deletes the folder; a result must not read from it then."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tesserae-{uuid.uuid4().hex}"
        if _made:
            _made[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back. The shuffle files of the write go as soon as it ends: nothing
        but the written table is read afterwards."""
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.unset(FREE_SHUFFLES) if before is None else self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """df with the outputs; an input column of an output's name (in any case) gives way."""
    taken = {name.lower() for name in outputs}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken], *[c.alias(n) for n, c in outputs.items()])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key written as text, modulo buckets; null keys count as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of a string column each, one row at least."""
    if not batch.num_rows:
        return
    array = batch.column(batch.schema.get_field_index(column))
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Contiguous groups of batches that are sorted by the keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if held_key is not None and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)
