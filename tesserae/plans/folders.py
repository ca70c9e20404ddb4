"""Queries over folders of files, written from the tables first."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.registry import Tables, query
from tesserae.session import shared_folder
from tesserae.sources import captures


def write_files(spark: SparkSession, root: str, files: dict[str, str]) -> None:
    """Small files by their paths below root, through the file system that Spark reads."""
    for name, text in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()


@query("""
SELECT 'capture ' || r_regionkey AS capture_id, ['photo', 'video', 'lidar'][r_regionkey % 3 + 1] AS tier, ['room_photos', 'videos', 'frame_files'][r_regionkey % 3 + 1] AS reader,
       CASE r_regionkey % 3 WHEN 0 THEN r_regionkey + 2 WHEN 1 THEN 1 ELSE 0 END::bigint AS items,
       CASE r_regionkey % 3 WHEN 0 THEN lower(r_name) || ': declared but not found;room: found but not declared' WHEN 1 THEN '' ELSE 'no depth frames' END AS warnings FROM region
""")
def capture_dispatch(t: Tables) -> DataFrame:
    """A capture folder for each region (a handful): photos, a clip, or a scan without depth."""
    root = shared_folder(t.spark)
    files = {}
    for key, name in sorted((r["r_regionkey"], r["r_name"]) for r in t.region.collect()):
        tier = ("photo", "video", "lidar")[key % 3]
        files[f"c{key}/capture.json"] = json.dumps({"capture_id": f"capture {key}", "tier": tier, "declared_rooms": [name.lower()]})
        files |= {f"c{key}/rooms/room/{i}.jpg": "x" for i in range(key + 2)} if tier == "photo" else {f"c{key}/walk.mov": "x"} if tier == "video" else {f"c{key}/odometry.csv": "frame\n"}
    write_files(t.spark, root, files)
    return captures.dispatched(t.spark, root).select("capture_id", "tier", "reader", "items", F.array_join("warnings", ";").alias("warnings"))


@query("""
SELECT p_brand AS label, p_partkey AS room, p_retailprice AS value, p_size > 25 AS flag FROM part
""")
def catalogue_round_trip(t: Tables) -> DataFrame:
    """Rows of a table written as CSV text and read back with their types."""
    root = shared_folder(t.spark)
    rows = t.part.select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("room"), F.col("p_retailprice").alias("value"), (F.col("p_size") > 25).alias("flag"))
    rows.write.csv(root, header=True)
    return t.spark.read.csv(root, header=True, schema=rows.schema)


_ELEMENTS = "['wall', 'opening', 'room', 'property', 'adjacency']"


@query(f"""
SELECT p_brand AS room, {_ELEMENTS}[p_partkey % 5 + 1] AS element, 'E' || p_partkey AS element_id, lower(p_type) AS dimension, p_retailprice AS value_m, p_name AS notes FROM part WHERE p_partkey % 7 <> 3
""")
def truth_files(t: Tables) -> DataFrame:
    """Parts as truth in CSV files, with blanks, capitals and lines without an element, read back as measurements."""
    root = shared_folder(t.spark)
    elements = F.array(*[F.lit(e) for e in captures.ELEMENTS])
    known = F.when(F.col("p_partkey") % 7 != 3, F.concat(F.lit("E"), "p_partkey"))
    rows = t.part.select(F.col("p_brand").alias("room"), F.upper(F.get(elements, (F.col("p_partkey") % 5).cast("int"))).alias("element"), known.alias("element_id"), F.col("p_type").alias("dimension"),
                         F.concat(F.lit(" "), "p_retailprice", F.lit(" ")).alias("value_m"), F.col("p_name").alias("notes"))
    rows.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root, header=True)
    return captures.ground_truth(t.spark, root).select("room", "element", "element_id", "dimension", "value_m", "notes")


@query("""
SELECT p_type AS damage_class, p_brand AS surface_kind, 'C' || p_partkey AS code, p_name AS unit, ['area', 'surface', 'extent', 'count'][p_partkey % 4 + 1] AS basis,
       CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END::double AS cut_back_m, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS waste_factor, 0.0::double AS min_quantity FROM part
""")
def pricing_files(t: Tables) -> DataFrame:
    """Parts as a price catalogue in CSV files, with blank fields, words for numbers and a column left out, read back for pricing."""
    root = shared_folder(t.spark)
    basis = F.get(F.array(*[F.lit(b) for b in ("Area", "SURFACE", "extent", "Count")]), (F.col("p_partkey") % 4).cast("int"))
    rows = t.part.select(F.col("p_type").alias("damage_class"), F.col("p_brand").alias("surface_kind"), F.concat(F.lit("C"), "p_partkey").alias("code"), F.col("p_name").alias("unit"), basis.alias("basis"),
                         F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("cut_back_m"), F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_retailprice").cast("string")).alias("waste_factor"))
    rows.write.csv(root, header=True)
    return captures.catalogue(t.spark, root)
