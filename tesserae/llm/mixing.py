"""Mixing sources to target weights by systematic sampling.

Sources get shares of the mix by weight. A share stops at a multiple of its source and the rest
is shared again by weight (filling with water). Then the documents of a source stand in a fixed
order, each with target / source size as its expected copies; the copies' prefix sum plus one
random offset for the source crosses an integer once for each copy that is taken.

The order is by size class, then by a hash of the key, so that every stretch holds its share of
words and a source's words come near its target. Prefix sums have two levels: rows for each
(source, class) and for each (source, class, slice), of which there are at most 256 in a class;
only then rows inside a slice. No source, however large, is sorted in one task.

Defined cases: a null source is a source of its own, last in code point order; a null or empty
text has size 0 and can still be taken; repeated rows stand beside each other and are sampled
one by one; an empty table gives an empty result; sources without words have target 0; an input
column with the name of an output gives way to it; the words of a text of any length are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, quoted, with_outputs

SLICES = 256


def _class_of(size: Column) -> Column:
    """Eight classes to the octave, rising with size; exact in doubles."""
    octave = F.length(F.bin(size + 1)) - 1
    return (octave * 8 + F.floor((size + 1) * 8 / F.pow(F.lit(2.0), octave)) - 8).cast("int")


def _unit(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(src, source_size) to (src, source_size, target); the null source ("") is the last.

    Ranks and water levels are windows over one row for each source in one task, which a name and
    three numbers a source bound: a million sources are about 100 MB. Where sources are hosts in
    greater numbers, mix their groups instead."""
    by_name = Window.orderBy(F.col("src") == "", "src")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    everyone = Window.partitionBy(F.lit(1))
    before = Window.orderBy("ratio", F.col("src") == "", "src").rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(everyone)
    free = F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / free).withColumn("place", F.row_number().over(Window.orderBy("ratio", F.col("src") == "", "src")))
    level = level.withColumn("level", F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), F.col("place"))).over(everyone))
    return level.select("src", "source_size", F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("w")), F.col("limit")).alias("target"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with size, source_size, target and copies (how often the mix
    takes the row). Words are counted once, into a table in the shared folder."""
    scratch = Scratch(docs.sparkSession)
    stay = [c for c in docs.columns if keep is None or c in keep]
    words = F.regexp_count(F.coalesce(quoted(text), F.lit("")), F.lit(WORD)).cast("long")
    name = F.md5(F.coalesce(quoted(key).cast("string"), F.lit("")))
    sized = docs.select(*map(quoted, stay), words.alias("__tsr_size"), name.alias("__tsr_hash"), F.coalesce(F.concat(F.lit("s"), quoted(source).cast("string")), F.lit("")).alias("__tsr_src"))
    sized = scratch.keep(sized, "sized")
    placed = sized.withColumns({"__tsr_class": F.coalesce(_class_of(F.col("__tsr_size")), F.lit(0)), "__tsr_slice": F.coalesce(F.conv(F.substring("__tsr_hash", 1, 2), 16, 10).cast("int") % SLICES, F.lit(0))})
    cells = scratch.keep(
        placed.groupBy("__tsr_src", "__tsr_class", "__tsr_slice").agg(F.count(F.lit(1)).alias("n"), F.sum("__tsr_size").alias("words")).toDF("src", "cls", "slice", "n", "words"), "cells")
    classes = cells.groupBy("src", "cls").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, cap)
    # src is "s" and the source's name, "" for null: an order of names in which null comes first,
    # and plain equality, so that the join and the window below share one exchange of the rows.
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("n").over(up_to("src").orderBy("cls")), F.lit(0)))
    inside = cells.withColumn("inside", F.coalesce(F.sum("n").over(up_to("src", "cls").orderBy("slice")), F.lit(0)))
    starts = inside.join(classes.select("src", "cls", "before"), ["src", "cls"]).select("src", "cls", "slice", (F.col("before") + F.col("inside")).alias("start"))
    starts = starts.join(targets, "src").select("src", "cls", "slice", "start", "source_size", "target")
    starts = scratch.keep(starts.toDF("__tsr_s", "__tsr_c", "__tsr_l", "__tsr_start", "__tsr_total", "__tsr_target"), "starts")
    joined = placed.hint("merge").join(starts, (F.col("__tsr_src") == F.col("__tsr_s")) & (F.col("__tsr_class") == F.col("__tsr_c")) & (F.col("__tsr_slice") == F.col("__tsr_l")))
    order = Window.partitionBy("__tsr_src", "__tsr_class", "__tsr_slice").orderBy("__tsr_hash", "__tsr_size")
    rank = F.col("__tsr_start") + F.row_number().over(order)
    rate = F.when(F.col("__tsr_total") > 0, F.col("__tsr_target") / F.col("__tsr_total")).otherwise(0.0)
    offset = _unit(F.concat(F.substring("__tsr_src", 2, 1 << 30), F.lit("|" + seed)))
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    out = with_outputs(joined, {"size": F.col("__tsr_size"), "source_size": F.col("__tsr_total"), "target": F.col("__tsr_target"), "copies": copies.cast("long")})
    return out.select(*[quoted(c) for c in out.columns if not c.startswith("__tsr_")])


def taken_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("__tsr_i", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("__tsr_i")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5(coalesce(doc_id::varchar, '')) AS h FROM documents),
c AS (SELECT *, length(bin(size + 1)) - 1 AS e, ('0x' || substr(h, 1, 2))::int AS slice FROM d),
k AS (SELECT *, (e * 8 + floor((size + 1) * 8 / pow(2.0, e)) - 8)::int AS cls FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, slice, h, size) AS rank FROM k),
s AS (SELECT source AS src, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1]::double AS w FROM s),
r AS (SELECT *, 2.0 * source_size::double AS lim, 2.0 * source_size::double / w AS ratio FROM w),
l AS (SELECT *, row_number() OVER (ORDER BY ratio, src NULLS LAST) AS place,
        (1.5::double * sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, coalesce(least(lim, w * (SELECT min_by(level, place) FROM l WHERE level < ratio)), lim)::double AS target FROM l),
j AS (SELECT doc_id, size, source_size, target, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5(coalesce(source, '') || '|mix'), 1, 8))::bigint / 4294967296.0::double AS u
      FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.src)
SELECT doc_id, size, source_size, target, size * (floor(rank * rate + u) - floor((rank - 1) * rate + u))::bigint AS taken FROM j
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
