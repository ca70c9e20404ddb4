"""Writers of plans, reports, run records and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested(parent: DataFrame, child: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """parent with the child rows of its keys as an ordered array of structs."""
    fields = [c for c in child.columns if c not in keys]
    first = order + [c for c in fields if c not in order]
    rows = F.sort_array(F.collect_list(F.struct(*first)))
    packed = child.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias(name))
    return parent.join(packed, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line, in a folder for each value of `by` if given."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def run_record(inputs: DataFrame, digest: Column, settings: dict[str, str]) -> DataFrame:
    """One row: number of inputs, an order-free digest of theirs, settings, and the time."""
    pairs = [x for k, v in sorted(settings.items()) for x in (F.lit(k), F.lit(str(v)))]
    return inputs.agg(F.count(F.lit(1)).alias("inputs"), F.lower(F.hex(F.bit_xor(F.xxhash64(digest)))).alias("digest")).withColumn("settings", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).withColumn("written_at", F.current_timestamp())


def text_table(rows: DataFrame, columns: list[str], limit: int = 10_000) -> str:
    """Left-justified columns with a header; for small reports, an error beyond the limit."""
    data = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns]).limit(limit + 1).collect()
    if len(data) > limit:
        raise ValueError(f"more than {limit} rows; this is for reports")
    wide = [max([len(c), *[len(r[c]) for r in data]]) for c in columns]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, wide)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in wide]), *[line([r[c] for c in columns]) for r in data]])
