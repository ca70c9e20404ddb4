"""The acceptance report: measured values against truth, month by month, and the matrix of all months.

    python -m jobs.acceptance_report --readings LINEITEM --truth PART --output OUT [--config jobs/acceptance_report.json]

A reading is a line with a tier (l_returnflag), a part, a quantity and a measured price; its truth is the quantity times
the part's list price. For each month of l_shipdate and each tier of the config there is one row a gate:

    accuracy       share of readings within the tier's tolerance
    coverage       share of readings whose interval (half_width, relative) holds the truth
    repeatability  share of parts read twice or more whose unit prices agree
    integrity      readings whose part is unknown (0 passes)

A tier without readings is a SKIP, never a PASS; tiers that the config does not name are not scored. Below OUT:

    gates/month=YYYY-MM   tier, gate, n, value, status
    matrix/gate=G         tier, months scored, pass rate and worst value over all months in gates

A run scores the months of the config (first and last, both included; null leaves an end open) and replaces the
partitions of those months that have readings, and no others, so that it can be run again; the matrix is made anew from the small gates table.
Null dates and tiers belong to no row of the report; a null price or quantity fails accuracy and coverage.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.measure import EPS, contains, relative, within
from tesserae.operators import gates

log = logging.getLogger("jobs.acceptance_report")
CONFIG = Path(__file__).with_suffix(".json")
GATES = "tier string, gate string, n long, value double, status string, month string"
LIMITS = ("abs_tol", "rel_tol", "fraction", "half_width")


def settings(path: str | Path = CONFIG) -> dict:
    with open(path) as lines:
        return json.load(lines)


def readings(lines: DataFrame, parts: DataFrame, config: dict) -> DataFrame:
    """Readings of the config's months and tiers with their truth and limits; the truth of an unknown part is null."""
    first, last = config["months"]
    rows = lines.filter(F.col("l_returnflag").isin(list(config["tiers"])) & F.col("l_shipdate").isNotNull())
    if first:
        rows = rows.filter(F.col("l_shipdate") >= F.to_timestamp(F.lit(f"{first}-01")))
    if last:
        rows = rows.filter(F.col("l_shipdate") < F.add_months(F.to_date(F.lit(f"{last}-01")), 1).cast("timestamp"))
    rows = rows.select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("tier"), "l_partkey", "l_orderkey", "l_quantity", F.col("l_extendedprice").alias("predicted"))
    known = parts.groupBy(F.col("p_partkey").alias("l_partkey")).agg(F.min("p_retailprice").alias("price"), F.lit(True).alias("known"))
    joined = rows.join(known, "l_partkey", "left")
    limit = lambda name: F.create_map(*[F.lit(x) for t, v in config["tiers"].items() for x in (t, float(v[name]))])[F.col("tier")]
    return joined.select("month", "tier", "l_partkey", "l_orderkey", "predicted", F.col("known").isNull().alias("unknown"), (F.col("l_quantity") * F.col("price")).alias("truth"), F.try_divide("predicted", "l_quantity").alias("unit"), *[limit(n).alias(n) for n in LIMITS])


def gate_rows(rows: DataFrame, config: dict) -> DataFrame:
    """(month, tier, gate, n, value, status) for every month with readings and every tier of the config."""
    ok = F.coalesce(within(F.col("predicted"), F.col("truth"), F.col("abs_tol"), F.col("rel_tol")), F.lit(False))
    held = F.coalesce(contains(relative(F.col("predicted"), F.col("half_width")), F.col("truth")), F.lit(False))
    known = ~F.col("unknown")
    judged = rows.groupBy("month", "tier").agg(F.count(F.lit(1)).alias("all"), F.count_if(known).alias("known"), F.count_if(known & ok).alias("ok"), F.count_if(known & held).alias("held"), F.count_if("unknown").alias("unknown"), F.min("fraction").alias("fraction"))
    again = config["repeat"]
    spreads = gates.repeat_spread(rows.filter(F.col("unit").isNotNull()), ["month", "tier", "l_partkey"], "unit", "l_orderkey", again["abs_tol"], again["rel_tol"])
    spreads = spreads.groupBy("month", "tier").agg(F.count(F.lit(1)).alias("repeats"), F.count_if("passed").alias("agree"))
    wanted = rows.sparkSession.createDataFrame([(t,) for t in config["tiers"]], "tier string")  # the config's tiers: a handful
    full = judged.select("month").distinct().join(F.broadcast(wanted), F.lit(True)).join(judged, ["month", "tier"], "left").join(spreads, ["month", "tier"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))

    def gate(name: str, n: str, value, passed):
        return F.struct(F.lit(name).alias("gate"), zero(F.col(n)).alias("n"), value.alias("value"), gates.status_of(zero(F.col(n)), passed).alias("status"))

    each = [
        gate("accuracy", "known", share("ok", "known"), share("ok", "known") >= F.col("fraction") - EPS),
        gate("coverage", "known", share("held", "known"), share("held", "known") >= config["coverage"] - EPS),
        gate("repeatability", "repeats", share("agree", "repeats"), share("agree", "repeats") >= again["fraction"] - EPS),
        gate("integrity", "all", F.col("unknown").cast("double"), F.col("unknown") == 0),
    ]
    return full.select("month", "tier", F.explode(F.array(*each)).alias("g")).select("tier", "g.*", "month")


def read_gates(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(GATES).parquet(f"{output}/gates")


def read_matrix(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(f"{output}/matrix")


def run(spark: SparkSession, lines: str, parts: str, output: str, config: dict) -> dict[str, int]:
    """Scores the config's months and returns how many readings were read and rows stand now."""
    spark.createDataFrame([], GATES).write.mode("append").partitionBy("month").parquet(f"{output}/gates")
    rows = readings(spark.read.parquet(lines), spark.read.parquet(parts), config)
    gate_rows(rows, config).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{output}/gates")
    higher = F.col("gate") != "integrity"
    matrix = gates.device_matrix(read_gates(spark, output), ["gate", "tier"], "value", "status", higher)
    matrix.write.mode("overwrite").partitionBy("gate").parquet(f"{output}/matrix")
    now = read_gates(spark, output)
    read = now.filter("gate = 'integrity'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    totals = {"readings": read, "gates": now.count(), "months": now.select("month").distinct().count()}
    log.info("scored months %s of %s against %s; %s holds %d gate rows of %d months over %d readings", config["months"], lines, parts, output, totals["gates"], totals["months"], totals["readings"])
    return totals


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("readings", "truth", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("acceptance-report").getOrCreate()
    try:
        run(spark, args.readings, args.truth, args.output.rstrip("/"), settings(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
