"""One-to-one pairing of two sides by least total |x - y|."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired_by_rank(left: DataFrame, right: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Rows of equal rank; the pairing of least cost for sides of equal size. Rows without a partner stay."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(value, key))
    a = left.select(group, rank.alias("r"), F.col(value).alias("x"), F.col(key).alias("left"))
    b = right.select(group, rank.alias("r"), F.col(value).alias("y"), F.col(key).alias("right"))
    return a.join(b, [group, "r"], "full_outer").drop("r")


def repeatability(pairs: DataFrame, group: str, absolute: float = 0.01, rel: float = 0.005) -> DataFrame:
    """Per group: pairs, total cost, and whether all are close; an unmatched row fails."""
    ok = F.coalesce(F.abs(F.col("x") - F.col("y")) <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs("x"), F.abs("y"))) + 1e-9, F.lit(False))
    cost = F.sum(F.abs(F.col("x") - F.col("y")))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.round(cost, 2).alias("cost"), F.every(ok).alias("passed"))


def monotone_assignment(x: np.ndarray, y: np.ndarray) -> list[int]:
    """For each of sorted x the index of its partner in sorted y, len(x) <= len(y): the least sum
    of |x - y|. With this cost some optimal pairing never crosses, so it is a shortest path over
    (x taken, y passed); each step is one running minimum."""
    n, m = len(x), len(y)
    cost = np.zeros(m + 1)
    took = np.zeros((n, m + 1), dtype=bool)
    for i in range(n):
        use = np.full(m + 1, np.inf)
        use[1:] = cost[:-1] + np.abs(y - x[i])
        best = np.minimum.accumulate(use)
        took[i] = use == best
        cost = best
    out, j = [0] * n, m
    for i in range(n - 1, -1, -1):
        while not took[i, j]:
            j -= 1
        j -= 1
        out[i] = j
    return out


def min_cost_pairs(left: DataFrame, right: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """All rows of both sides, matched where the other side has enough. A group is one task's
    data frame: groups are captures or rooms, of bounded size."""
    schema = f"{group} {dict(left.dtypes)[group]}, left {dict(left.dtypes)[key]}, right {dict(right.dtypes)[key]}, cost double"

    def pair(keys: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # a side without rows comes without columns
        a, b = (x.sort_values([value, key], ignore_index=True) if len(x) else pd.DataFrame({value: [], key: []}) for x in (a, b))
        small, large, swap = (a, b, False) if len(a) <= len(b) else (b, a, True)
        to = monotone_assignment(small[value].to_numpy(float), large[value].to_numpy(float)) if len(small) else []
        rows = [(small[key][i], large[key][j], abs(small[value][i] - large[value][j])) for i, j in enumerate(to)]
        rows += [(None, large[key][j], None) for j in sorted(set(range(len(large))) - set(to))]
        out = pd.DataFrame([(r[1], r[0], r[2]) if swap else r for r in rows], columns=["left", "right", "cost"])
        out.insert(0, group, keys[0])
        return out.astype({"left": "Int64", "right": "Int64"}) if len(out) else out

    # columns of their own for each side, which may be two parts of one table
    a, b = (df.select(*[F.col(c).alias(c) for c in (group, value, key)]) for df in (left, right))
    return a.groupBy(group).cogroup(b.groupBy(group)).applyInPandas(pair, schema)
