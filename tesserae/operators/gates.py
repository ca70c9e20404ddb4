"""Scoring against truth: matching, gates with PASS, FAIL and SKIP, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.measure import EPS, within


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def matched(predicted: DataFrame, truth: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Predictions with the first truth of their key; predictions without one are dropped."""
    return predicted.join(first_of_each(truth, keys, order), keys, "inner")


def status_of(count: Column, passed: Column) -> Column:
    return F.when(count == 0, "SKIP").when(passed, "PASS").otherwise("FAIL")


def tolerance_gate(pairs: DataFrame, limits: DataFrame, tier: str = "tier", predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """limits (tier, abs_tol, rel_tol, fraction), a few rows, to one row each: n, passed, fraction
    reached, worst error and status. A tier without pairs is a SKIP, never a PASS."""
    ok = within(F.col(predicted), F.col(truth), F.col("abs_tol"), F.col("rel_tol"))
    judged = pairs.join(F.broadcast(limits), tier).groupBy(tier).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.max(F.abs(F.col(predicted) - F.col(truth))).alias("worst"))
    out = limits.join(judged, tier, "left")
    n, passed = F.coalesce("n", F.lit(0)), F.coalesce("passed", F.lit(0))
    share = F.try_divide(passed.cast("double"), n)
    return out.select(tier, n.alias("n"), passed.alias("passed"), share.alias("share"), "worst", status_of(n, share >= F.col("fraction") - EPS).alias("status"))


def all_pass_gate(rows: DataFrame, group: list[str], ok: Column, error: Column, element: Column) -> DataFrame:
    """n, whether every row passes, the largest error and the first element that has it."""
    worst = F.min_by(element, F.struct(-error, element))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.every(ok).alias("passed"), F.max(error).alias("worst"), worst.alias("worst_element"))


def detection_gate(predicted: DataFrame, truth: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Per scope that has truth: matched, missed (truth only), phantom (prediction only)."""
    p = predicted.select(*keys, scope).distinct().withColumn("__p", F.lit(True))
    t = truth.select(*keys, scope).distinct().withColumn("__t", F.lit(True))
    covered = t.select(scope).distinct()
    both = p.join(t, [*keys, scope], "full_outer").join(covered, scope, "left_semi")
    hit, miss = F.col("__p").isNotNull() & F.col("__t").isNotNull(), F.col("__p").isNull()
    out = both.groupBy(scope).agg(F.count_if(hit).alias("matched"), F.count_if(miss).alias("missed"), F.count_if(F.col("__t").isNull()).alias("phantom"))
    return out.withColumn("fraction", F.col("matched") / (F.col("matched") + F.col("missed") + F.col("phantom")))


def belongs(truth: DataFrame, ids: DataFrame, key: str, group: str) -> DataFrame:
    """Groups of truth of which at least one id is known."""
    return truth.join(ids.select(key).distinct(), key, "left_semi").select(group).distinct()


def device_matrix(results: DataFrame, keys: list[str], value: str, status: str, higher: Column) -> DataFrame:
    """Per key: rows scored (not SKIP, with a value), their pass rate, and the worst value, which
    is the least where higher is better. Keys without scored rows stay, with nulls."""
    scored = (F.col(status) != "SKIP") & F.col(value).isNotNull()
    seen = F.when(scored, F.col(value))
    return results.withColumn("__higher", higher).groupBy(*keys).agg(
        F.count_if(scored).alias("n_scored"), F.avg(F.when(scored, (F.col(status) == "PASS").cast("double"))).alias("pass_rate"),
        F.when(F.max("__higher"), F.min(seen)).otherwise(F.max(seen)).alias("worst"))


def repeat_spread(rows: DataFrame, group: list[str], value: str, key: str, absolute: float, rel: float) -> DataFrame:
    """Groups of two rows or more: their spread, which rows hold its ends, and whether the spread
    is within the larger of an absolute and a relative limit. No pairs are made: the worst pair
    of a group is its least and its largest value."""
    low, high = F.min(F.struct(value, key)), F.max(F.struct(F.col(value), (-F.col(key)).alias("neg")))
    out = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), low.alias("lo"), high.alias("hi")).filter("n > 1")
    a, b = F.col("lo")[value], F.col("hi")[value]
    limit = F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))
    return out.select(*group, "n", (b - a).alias("spread"), F.col("lo")[key].alias("low_key"), (-F.col("hi")["neg"]).alias("high_key"), (b - a <= limit + EPS).alias("passed"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """(check, n): rows of child whose key is not null and has no parent."""
    keys = parent.select(F.col(parent_key).alias("__k")).distinct()
    missing = child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("__k"), "left_anti")
    return missing.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))


def set_difference(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): what is declared and not found, and the other way round."""
    a, b = declared.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("undeclared")))


def pair_truth(pairs: DataFrame, truth: DataFrame, a: str, b: str, expected: Column) -> DataFrame:
    """Unordered pairs against truth rows of unordered pairs: per truth row, whether the pair is
    there as expected. Truth rows of one id or none are skipped."""
    key = lambda x, y: (F.least(x, y).alias("__a"), F.greatest(x, y).alias("__b"))
    have = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*key(F.col(a), F.col(b))).distinct().withColumn("__is", F.lit(True))
    want = truth.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*key(F.col(a), F.col(b)), expected.alias("expected"))
    joined = want.join(have, ["__a", "__b"], "left").withColumn("actual", F.coalesce("__is", F.lit(False)))
    return joined.select(F.col("__a").alias("a"), F.col("__b").alias("b"), "expected", "actual", (F.col("expected") == F.col("actual")).alias("correct"))
