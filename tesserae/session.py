"""A local session with the settings the tests and the bench use."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the session's Python workers, once for each application,
    unless PYTHONPATH already leads them to it."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tesserae-source-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tesserae.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(f"{folder}/tesserae.zip")
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name where driver and executors share files: below spark.checkpoint.dir, else below the
    context's checkpoint folder, else (sessions in one process only) in a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (held := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = held.get()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/tesserae-{uuid.uuid4().hex}"


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "tesserae", memory: str = "8g") -> SparkSession:
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Steps:
    """Tables between the rounds of a loop, in a folder of their own below shared_folder: each is written and read
    again, so plans stay short and a lost executor loses nothing. Keeping a name anew deletes what it named before,
    unless the name is in `held`."""

    def __init__(self, spark: SparkSession, *held: str):
        self.spark, self.root, self.held = spark, shared_folder(spark), held
        self.made: dict[str, int] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        number = self.made[name] = self.made.get(name, -1) + 1
        df.write.parquet(f"{self.root}/{name}-{number}")
        if number and name not in self.held:
            self.drop(f"{name}-{number - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}-{number}")

    def drop(self, folder: str = "") -> None:
        """Deletes one table, or all of them; what is still read from must have been written elsewhere by then."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}" if folder else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
