"""Interval calibration: how much wider intervals must be to cover what they claim."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.measure import EPS
from tesserae.session import Steps


def required_factor(error: Column, half: Column) -> Column:
    """The factor at which the interval just covers: 0 for no error, infinite for an error of a
    zero-width interval."""
    return F.when(half > 0, error / half).when(error <= EPS, F.lit(0.0)).otherwise(F.lit(float("inf")))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantile: float, name: str, accuracy: int = 10_000) -> DataFrame:
    """(keys, name): F.percentile() of each key, null without values, for keys of any size: no task holds a key's values.

    An estimate brackets the wanted ranks; what lies below, in and above the bracket is counted, and only those of the
    three parts that hold a wanted rank are sorted, value by value. A poor estimate costs time, never exactness."""
    steps = Steps(rows.sparkSession)
    v = F.col(value)
    around = [max(0.0, quantile - 2 / accuracy), min(1.0, quantile + 2 / accuracy)]
    guess = steps.keep(rows.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(float(p)) for p in around]), accuracy).alias("__g")).select(*keys, F.col("__g")[0].alias("__lo"), F.col("__g")[1].alias("__hi")), "guess")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    beside = lambda df: df.select(*[F.col(k).alias(f"__of_{k}") for k in keys], *[c for c in df.columns if c not in keys])
    part = F.when(v < F.col("__lo"), 0).when(v <= F.col("__hi"), 1).otherwise(2)
    placed = rows.filter(v.isNotNull()).select(*keys, value).join(beside(guess), same).select(*keys, value, part.alias("__part"))
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__part") == 0).alias("__n0"), F.count_if(F.col("__part") == 1).alias("__n1"))
    at = (F.col("__n") - 1) * F.lit(float(quantile))
    counts = steps.keep(counts.withColumn("__at", at).withColumn("__k0", F.floor("__at")).withColumn("__k1", F.ceil("__at")), "counts")
    first = F.when(F.col("__part") == 0, F.lit(0)).when(F.col("__part") == 1, F.col("__n0")).otherwise(F.col("__n0") + F.col("__n1"))
    after = F.when(F.col("__part") == 0, F.col("__n0")).when(F.col("__part") == 1, F.col("__n0") + F.col("__n1")).otherwise(F.col("__n"))
    wanted = placed.join(beside(counts), same).withColumn("__first", first).withColumn("__after", after)
    wanted = wanted.filter((F.col("__k0").between(F.col("__first"), F.col("__after") - 1)) | F.col("__k1").between(F.col("__first"), F.col("__after") - 1))
    sums = wanted.groupBy(*keys, "__part", "__first", "__at", "__k0", "__k1", value).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.col("__first") + F.sum("__c").over(Window.partitionBy(*keys, "__part").orderBy(value))
    has = lambda k: F.max(F.when((F.col(k) < F.col("__upto")) & (F.col(k) >= F.col("__upto") - F.col("__c")), v))
    ends = sums.withColumn("__upto", upto).groupBy(*keys, "__at", "__k0", "__k1").agg(has("__k0").alias("__a"), has("__k1").alias("__b"))
    a, b = F.col("__a"), F.col("__b")
    between = F.when(a == b, a).otherwise((F.col("__k1") - F.col("__at")) * a + (F.col("__at") - F.col("__k0")) * b)
    found = beside(ends.select(*keys, between.cast("double").alias(name)))
    return steps.keep(guess.select(*keys).join(found, same, "left").select(*keys, name), "quantiles")


def fit_factors(samples: DataFrame, keys: list[str], error: str = "error", half: str = "half_width", quantile: float = 0.95, low: float = 1.0, high: float = 6.0, enough: int = 3) -> DataFrame:
    """Per key: n, the exact quantile of the finite required factors, clipped; coverage of all
    samples at that factor, infinite ones counted as not covered; and whether n is enough.
    Without finite samples the factor is 1 and the coverage 0."""
    rows = samples.withColumn("required", required_factor(F.col(error), F.col(half)))
    bounded = F.when(F.col("required") < float("inf"), F.col("required"))
    fitted = exact_quantiles(rows.withColumn("required", bounded), keys, "required", quantile, "raw")
    factor = F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), F.col("raw"))), F.lit(1.0))
    fitted = fitted.select(*keys, "raw", factor.alias("factor"))
    covered = F.avg(((F.col("required") <= F.col("factor") + EPS) & F.col("raw").isNotNull()).cast("double"))
    out = rows.join(fitted, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("raw").alias("raw"), F.max("factor").alias("factor"), covered.alias("coverage"))
    return out.withColumn("trusted", F.col("n") >= enough)


def recalibrated(samples: DataFrame, factors: DataFrame, keys: list[str], half: str = "half_width") -> DataFrame:
    """samples with the half width times the factor of their key; without one, as it was. The few factors are a table,
    so that Spark knows their size and ships them instead of sorting samples by key."""
    few = Steps(samples.sparkSession).keep(factors.select(*keys, F.col("factor").alias("__f")), "factors")
    joined = samples.join(few, keys, "left")
    return joined.withColumn(half, F.col(half) * F.coalesce("__f", F.lit(1.0))).drop("__f")
