"""Flags for inspectors' notes as they arrive, and how often each source gives cause for which.

    python -m jobs.notes_feed --input NOTES --output OUT --checkpoint CHECKPOINT [--config jobs/notes_feed.json]

NOTES is a folder of notes or a pattern of such (one file is named by a pattern too, as notes.parque[t]): doc_id, text, lang, source. A run reads, as a file stream, the files that the
checkpoint does not know yet, ends when they are done, and leaves below OUT

    flags/batch=N/rule_id=R   one row for each note and rule that fires: doc_id, source, lang, severity, reasons
    notes/batch=N             the number of notes of each source
    report                    source, rule_id, notes, flagged: sums over all batches

A batch writes only the partitions of its own number, in dynamic overwrite mode, so that a batch that is run again after a
failure replaces what it had written. The report is made anew from the small tables of counts. Every
delivered row counts: a note that is sent in two files is flagged twice.

Null and empty texts are notes of no words; null sources are a source of their own; columns that are not named above are not read;
without files the tables are there and empty.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.rules import checked_rules, firings

log = logging.getLogger("jobs.notes_feed")
CONFIG = Path(__file__).with_suffix(".json")
NOTES = "doc_id long, text string, lang string, source string"
FLAGS = "doc_id long, source string, lang string, severity int, reasons string, batch long, rule_id string"
COUNTS = "source string, notes long, batch long"


def settings(path: str | Path = CONFIG) -> dict:
    with open(path) as lines:
        return json.load(lines)


def _times(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def note_fields(phrases: dict[str, list[str]]) -> dict[str, Column]:
    """What rules may ask about a note, by name."""
    text = F.coalesce("text", F.lit(""))
    letters, lowered = F.regexp_count(text, F.lit("[A-Za-z]")), F.lower(text)
    fields = {
        "n_words": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
        "upper_pct": F.coalesce(F.floor(F.try_divide(100 * F.regexp_count(text, F.lit("[A-Z]")), letters)), F.lit(0)),
        "mails": F.regexp_count(text, F.lit(r"[0-9A-Za-z.]+@[0-9A-Za-z.]+")),
        "cells": _times(text, " | "),
        "marks": _times(text, "!!"),
    }
    return fields | {f"hits_{name}": reduce(lambda a, b: a + b, [_times(lowered, p.lower()) for p in parts]) for name, parts in phrases.items()}


def asked(notes: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """Notes without their text, with the fields that rules ask about."""
    return notes.select("doc_id", "source", "lang", *[c.cast("long").alias(n) for n, c in note_fields(phrases).items()])


def flags(fields: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each note and rule that fires, with the values that made it fire."""
    severity = F.element_at(F.array(*[F.lit(int(r["severity"])) for r in rules]), F.col("rule_pos") + 1)
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return firings(fields, rules).select("doc_id", "source", "lang", severity.alias("severity"), reasons.alias("reasons"), "rule_id")


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_flags(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(FLAGS).parquet(f"{output}/flags")


def read_report(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/report")


def report(spark: SparkSession, output: str) -> DataFrame:
    """Sums over all batches; a source without flags has a row whose rule is null."""
    notes = spark.read.schema(COUNTS).parquet(f"{output}/notes").groupBy("source").agg(F.sum("notes").alias("notes"))
    flagged = read_flags(spark, output).groupBy(F.col("source").alias("s"), "rule_id").agg(F.count(F.lit(1)).alias("flagged"))
    return notes.join(flagged, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "rule_id", "notes", F.coalesce("flagged", F.lit(0)).alias("flagged"))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes the files that are new, and returns how many batches and notes were read and flags stand now."""
    for name, schema, by in (("flags", FLAGS, ["batch", "rule_id"]), ("notes", COUNTS, ["batch"])):
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")

    rules = checked_rules(config["rules"], list(note_fields(config["phrases"])))
    done: list[int] = []

    def batch(fields: DataFrame, number: int) -> None:
        mark = F.lit(number).cast("long").alias("batch")
        fields.persist()  # numbers, no texts: notes are read once for both tables, again only where an executor was lost
        try:
            _put(flags(fields, rules).select("*", mark), f"{output}/flags", "batch", "rule_id")
            _put(fields.groupBy("source").agg(F.count(F.lit(1)).alias("notes")).select("*", mark), f"{output}/notes", "batch")
        finally:
            fields.unpersist()
        done.append(number)

    stream = spark.readStream.schema(NOTES).option("maxFilesPerTrigger", int(config["files_per_batch"])).format(config["format"]).load(source)
    query = asked(stream, config["phrases"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    report(spark, output).write.mode("overwrite").parquet(f"{output}/report")
    counts = spark.read.schema(COUNTS).parquet(f"{output}/notes").filter(F.col("batch").isin(done))
    notes = counts.agg(F.coalesce(F.sum("notes"), F.lit(0)).alias("n")).first()["n"]
    totals = {"batches": len(done), "notes": notes, "flags": read_flags(spark, output).count()}
    log.info("read %d new notes of %s in %d batches; %s holds %d flags", totals["notes"], source, totals["batches"], output, totals["flags"])
    return totals


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("notes-feed").getOrCreate()
    try:
        run(spark, args.input, args.output.rstrip("/"), args.checkpoint, settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
