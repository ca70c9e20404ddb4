"""Readers of capture folders. Each reads any number of captures at once, keyed by folder."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the capture format.
TIERS = ("photo", "video", "lidar")
ELEMENTS = ("wall", "opening", "room", "property", "adjacency")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "heic", "heif", "webp", "dng")
VIDEO_SUFFIXES = ("mov", "mp4", "m4v")
PHOTOS_A_ROOM = (2, 8)

MANIFEST = T.StructType([
    T.StructField("capture_id", T.StringType()), T.StructField("tier", T.StringType()),
    T.StructField("device", T.StructType([T.StructField("model", T.StringType()), T.StructField("os_version", T.StringType()), T.StructField("has_lidar", T.BooleanType())])),
    T.StructField("captured_at", T.TimestampType()), T.StructField("operator", T.StringType()), T.StructField("declared_rooms", T.ArrayType(T.StringType())),
    T.StructField("space_id", T.StringType()), T.StructField("video_path", T.StringType()), T.StructField("notes", T.StringType()),
])


def folder_of(path: Column, up: int = 1) -> Column:
    """The folder of a path, in the one spelling of local paths that listings use."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "file:/"), r"(/[^/]*)" * up + "$", "")


def required(value: Column, ok: Column, message: Column | str) -> Column:
    """The value, or an error that ends the query when ok does not hold."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(text).cast("string"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def strict_json(texts: DataFrame, text: str, schema: T.StructType, where: str) -> DataFrame:
    """texts with `value`, the parsed JSON; broken JSON and keys beyond the schema are errors, at
    the top and in nested objects (Spark's reader would drop such keys silently)."""
    def unknown(raw: Column, kind: T.StructType, prefix: str) -> Column:
        names = F.array(*[F.lit(f.name) for f in kind.fields])
        out = F.transform(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), names), lambda k: F.concat(F.lit(prefix), k))
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                out = F.concat(out, unknown(F.get_json_object(raw, f"$.{f.name}"), f.dataType, f"{prefix}{f.name}."))
        return out

    raw = F.col(text)
    odd = unknown(raw, schema, "")
    broken = F.json_object_keys(raw).isNull()
    complaint = F.concat(F.col(where), F.when(broken, F.lit(": invalid JSON")).otherwise(F.concat(F.lit(": unknown keys "), F.array_join(odd, ", "))))
    checked = required(raw, ~broken & (F.size(odd) == 0), complaint)
    return texts.withColumn("value", F.from_json(checked, schema, {"mode": "FAILFAST"}))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row for each capture.json below root: folder and the manifest's fields. A blank id, an
    unknown tier, broken JSON or an unknown key is an error that names the file."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "capture.json").load(root)
    rows = strict_json(files.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path")), "raw", MANIFEST, "path")
    name = F.trim("value.capture_id")
    rows = rows.withColumn("id", required(name, name != "", F.concat("path", F.lit(": capture_id must not be empty"))))
    rows = rows.withColumn("tier", required(F.col("value.tier"), F.col("value.tier").isin(*TIERS), F.concat("path", F.lit(": unknown tier"))))
    device = F.coalesce("value.device.model", F.lit("unknown"))
    rest = [F.col(f"value.{f.name}").alias(f.name) for f in MANIFEST.fields if f.name not in ("capture_id", "tier", "declared_rooms")]
    return rows.select(folder_of(F.col("path")).alias("folder"), F.col("id").alias("capture_id"), "tier", device.alias("device_model"), F.coalesce("value.declared_rooms", F.array().cast("array<string>")).alias("declared_rooms"), *rest)


def room_photos(spark: SparkSession, captures: DataFrame, root: str) -> DataFrame:
    """(folder, room, path, place): photos of captures, sorted by name within their room. Folders
    below rooms/ come first, then folders of the capture itself, then loose photos as room_1."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = listing(spark, root).filter(suffix.isin(*IMAGE_SUFFIXES)).select("path", folder_of(F.col("path")).alias("home"))
    last = F.regexp_extract("home", r"([^/]*)$", 1)
    ways = F.array(
        F.struct(F.lit(1).alias("way"), F.when(F.col("home").rlike("/rooms/[^/]+$"), folder_of(F.col("home"), 2)).alias("folder"), last.alias("room")),
        F.struct(F.lit(2).alias("way"), folder_of(F.col("home")).alias("folder"), last.alias("room")),
        F.struct(F.lit(3).alias("way"), F.col("home").alias("folder"), F.lit("room_1").alias("room")),
    )
    found = files.withColumn("w", F.explode(ways)).select("path", "w.*").join(captures.select("folder").distinct(), "folder")
    from pyspark.sql import Window

    best = F.min("way").over(Window.partitionBy("folder"))
    place = F.row_number().over(Window.partitionBy("folder", "room").orderBy(F.regexp_extract("path", r"([^/]*)$", 1), "path")) - 1
    return found.withColumn("best", best).filter("way = best").select("folder", "room", "path", place.alias("place"))


def photo_warnings(captures: DataFrame, photos: DataFrame) -> DataFrame:
    """(folder, room, warning): rooms with too few or too many photos, and rooms that are declared
    and not found or found and not declared."""
    low, high = PHOTOS_A_ROOM
    n = photos.groupBy("folder", "room").agg(F.count(F.lit(1)).alias("n"))
    counts = n.filter(~F.col("n").between(low, high)).select("folder", "room", F.format_string("%d photos, expected %d to %d", "n", F.lit(low), F.lit(high)).alias("warning"))
    declared = captures.select("folder", F.explode("declared_rooms").alias("room")).distinct()
    found = n.join(declared.select("folder").distinct(), "folder", "left_semi").select("folder", "room")
    missing = declared.join(found, ["folder", "room"], "left_anti").withColumn("warning", F.lit("declared but not found"))
    extra = found.join(declared, ["folder", "room"], "left_anti").withColumn("warning", F.lit("found but not declared"))
    return counts.unionByName(missing).unionByName(extra)


def videos(spark: SparkSession, captures: DataFrame, root: str) -> DataFrame:
    """(folder, path, length): the clip that the manifest names, else the first by name."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = listing(spark, root).filter(suffix.isin(*VIDEO_SUFFIXES)).withColumn("folder", folder_of(F.col("path")))
    named = captures.select(F.col("folder").alias("f"), F.concat("folder", F.lit("/"), "video_path").alias("named"))
    joined = files.join(named, F.col("folder") == F.col("f"))
    rank = F.struct((F.col("path") != F.coalesce("named", F.lit(""))).alias("other"), "path")
    return joined.groupBy("folder").agg(F.min_by(F.struct("path", "length"), rank).alias("v")).select("folder", "v.*")


def dispatched(spark: SparkSession, root: str) -> DataFrame:
    """One row for each capture below root: folder, capture_id, tier, the reader that its tier (never a
    flag) chooses, how many items that reader finds, and warnings in order. A video capture without a
    clip is an error."""
    rows = manifests(spark, root)
    photos = room_photos(spark, rows.filter("tier = 'photo'"), root)
    of_photos = photos.groupBy("folder").agg(F.count(F.lit(1)).alias("photos"))
    clips = videos(spark, rows.filter("tier = 'video'"), root).select("folder", F.lit(1).alias("clips"))
    depth = listing(spark, root).filter(F.lower("path").rlike(r"/depth/[^/]+\.png$")).groupBy(folder_of(F.col("path"), 2).alias("folder")).agg(F.count(F.lit(1)).alias("frames"))
    said = photo_warnings(rows.filter("tier = 'photo'"), photos).groupBy("folder").agg(F.sort_array(F.collect_list(F.concat("room", F.lit(": "), "warning"))).alias("said"))
    every = rows.select("folder", "capture_id", "tier")
    for part in (of_photos, clips, depth, said):
        every = every.join(part, "folder", "left")
    tier = F.col("tier")
    items = F.coalesce(F.when(tier == "photo", F.col("photos")).when(tier == "video", F.col("clips")).otherwise(F.col("frames")), F.lit(0)).cast("long")
    reader = F.when(tier == "photo", "room_photos").when(tier == "video", "videos").otherwise("frame_files")
    reader = required(reader, (tier != "video") | (items > 0), F.concat("folder", F.lit(": a video capture without a clip")))
    none = F.array().cast("array<string>")
    blind = F.when((tier == "lidar") & (items == 0), F.array(F.lit("no depth frames"))).otherwise(none)
    return every.select("folder", "capture_id", "tier", reader.alias("reader"), items.alias("items"), F.concat(F.coalesce("said", none), blind).alias("warnings"))


def poses(spark: SparkSession, folder: str) -> DataFrame:
    """odometry.csv with its header names stripped and all values as doubles, and its frame number."""
    raw = spark.read.csv(f"{folder}/odometry.csv", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c.strip()) for c in raw.columns]).withColumn("frame", F.col("frame").cast("long"))


def intrinsics(spark: SparkSession, folder: str, depth_width: float | None = None, rgb_width: float | None = None) -> DataFrame:
    """One row fx, fy, cx, cy of the 3 by 3 camera matrix, scaled to the depth width if given."""
    rows = spark.read.csv(f"{folder}/camera_matrix.csv", schema="a double, b double, c double", ignoreLeadingWhiteSpace=True)
    scale = depth_width / rgb_width if depth_width and rgb_width else 1.0
    first, second = (F.col("a") != 0), (F.col("a") == 0) & (F.col("b") != 0)
    return rows.agg(*[(F.max(F.when(at, F.col(c))) * scale).alias(n) for n, c, at in (("fx", "a", first), ("cx", "c", first), ("fy", "b", second), ("cy", "c", second))])


def frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """(frame, depth, confidence) by position in name order; an error if their numbers differ."""
    from pyspark.sql import Window

    def of(kind: str) -> DataFrame:
        files = listing(spark, f"{folder}/{kind}").filter(F.lower("path").endswith(".png"))
        return files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("frame"), F.col("path").alias(kind))

    both = of("depth").join(of("confidence"), "frame", "full_outer")
    ok = F.col("depth").isNotNull() & F.col("confidence").isNotNull()
    return both.select("frame", required(F.col("depth"), ok, "depth and confidence frame counts differ").alias("depth"), "confidence")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """room, element, element_id, dimension, value_m, method, notes, line. Missing columns, unknown
    elements and values that are no numbers are errors; rows without an element id are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := {"room", "element", "element_id", "dimension", "value_m"} - set(raw.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = raw.withColumn("line", F.monotonically_increasing_id() + 2).filter(clean("element_id") != "")
    element, value = F.lower(clean("element")), F.expr("try_cast(trim(value_m) AS double)")
    optional = [clean(c).alias(c) if c in raw.columns else F.lit("").alias(c) for c in ("method", "notes")]
    return rows.select(clean("room").alias("room"), required(element, element.isin(*ELEMENTS), F.concat(F.lit("unknown element "), element)).alias("element"), clean("element_id").alias("element_id"), F.lower(clean("dimension")).alias("dimension"),
                       required(value.cast("string"), value.isNotNull(), F.concat(F.lit("not a number: "), F.coalesce("value_m", F.lit("")))).cast("double").alias("value_m"), *optional, "line")


def plans(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All plan.json below root (or one file), strictly parsed, with the folder each lies in."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "plan.json").load(root)
    rows = strict_json(files.select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path")), "raw", schema, "path")
    return rows.select(folder_of(F.col("path")).alias("folder"), "value.*")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Pricing rows; blanks count as 0 and an unknown basis is an error."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := {"damage_class", "surface_kind", "code", "unit", "basis"} - set(raw.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    number = lambda c: F.coalesce(F.expr(f"try_cast(trim({c}) AS double)"), F.lit(0.0)).alias(c) if c in raw.columns else F.lit(0.0).alias(c)
    basis = F.lower(F.trim("basis"))
    return raw.select(*[F.trim(c).alias(c) for c in ("damage_class", "surface_kind", "code", "unit")], required(basis, basis.isin("area", "surface", "extent", "count"), F.concat(F.lit("unknown basis "), basis)).alias("basis"), *[number(c) for c in ("cut_back_m", "waste_factor", "min_quantity")])


def calibration_factors(spark: SparkSession, path: str) -> DataFrame:
    """(tier, kind, scale, n_samples, achieved_coverage, trusted); none where the file is missing or
    unreadable, so that every factor is 1."""
    entry = "struct<scale:double,n_samples:long,achieved_coverage:double,trusted:boolean>"
    schema = f"struct<factors:map<string,map<string,{entry}>>>"
    empty = f"tier string, kind string, {entry[7:-1].replace(':', ' ')}"
    try:
        raw = spark.read.format("text").option("wholetext", "true").load(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], empty)
    parsed = raw.select(F.from_json("value", schema).alias("v"))
    tiers = parsed.select(F.explode("v.factors").alias("tier", "kinds"))
    return tiers.select("tier", F.explode("kinds").alias("kind", "e")).select("tier", "kind", "e.*")


def rules(path: str, fields: list[str]) -> list[dict]:
    """Rules from a YAML or JSON file on the driver, validated."""
    from tesserae.operators.rules import checked_rules

    with open(path) as source:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("YAML rules need PyYAML; JSON rules do not") from error
            data = yaml.safe_load(source)
        else:
            data = json.load(source)
    return checked_rules(data.get("rules") or [], fields)
