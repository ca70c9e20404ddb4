"""Operators over ordered rows: runs, gaps, buckets, segments, brackets. `keys` name the columns
that separate sequences; every window has a total order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import spatial
from tesserae.session import Steps


def runs(marked: DataFrame, keys: list[str], index: str, tolerance: int = 0) -> DataFrame:
    """Rows stand for the true places of a sequence. (start, stop, n): maximal runs as half-open
    ranges, bridged over gaps of at most `tolerance` places; n counts true places."""
    order = Window.partitionBy(*keys).orderBy(index)
    gap = F.col(index) - F.lag(index).over(order) - 1
    cut = F.when(gap <= tolerance, 0).otherwise(1)
    grouped = marked.select(*keys, index).distinct().withColumn("__cut", cut).withColumn("__run", F.sum("__cut").over(order))
    return grouped.groupBy(*keys, "__run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"), F.count(F.lit(1)).alias("n")).drop("__run")


def first_sustained(marked: DataFrame, keys: list[str], index: str, k: int) -> DataFrame:
    """First place from which k consecutive places are true, per sequence that has one."""
    order = Window.partitionBy(*keys).orderBy(index)
    ahead = F.lead(index, k - 1).over(order) if k > 1 else F.col(index)
    return marked.select(*keys, index).distinct().withColumn("__ahead", ahead).filter(F.col("__ahead") == F.col(index) + k - 1).groupBy(*keys).agg(F.min(index).alias("first"))


def interior_gaps(marked: DataFrame, keys: list[str], index: str) -> DataFrame:
    """[low, high) runs of false places that are closed by true ones on both sides."""
    before = F.lag(index).over(Window.partitionBy(*keys).orderBy(index))
    gaps = marked.select(*keys, index).distinct().withColumn("__before", before).filter(F.col(index) - F.col("__before") > 1)
    return gaps.select(*keys, (F.col("__before") + 1).alias("low"), F.col(index).alias("high"))


def columns_of(cells: DataFrame, keys: list[str], n_columns: int, n_rows: int, least: int = 3, sustained: int = 3) -> DataFrame:
    """Occupied cells (keys, col, row) to one row for each column of each grid: observed (at least
    `least` occupied cells) and clearance, the place of the first sustained run, else n_rows."""
    spine = cells.select(*keys).distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(n_columns - 1))))
    seen = cells.groupBy(*keys, "col").agg(F.countDistinct("row").alias("filled"))
    first = first_sustained(cells, [*keys, "col"], "row", sustained)
    out = spine.join(seen, [*keys, "col"], "left").join(first, [*keys, "col"], "left")
    observed = F.coalesce(F.col("filled") >= least, F.lit(False))
    return out.select(*keys, "col", observed.alias("observed"), F.when(observed, F.coalesce("first", F.lit(n_rows))).otherwise(F.lit(n_rows)).alias("clearance"))


def flanked(columns: DataFrame, keys: list[str], limit: int, search: int) -> DataFrame:
    """columns with left and right: whether the nearest observed column within `search` columns on
    that side reaches low enough."""
    order = Window.partitionBy(*keys).orderBy("col")
    seen = F.when(F.col("observed"), F.col("clearance"))
    low = lambda c: F.coalesce(c <= limit, F.lit(False))
    return columns.withColumn("left", low(F.last(seen, ignorenulls=True).over(order.rowsBetween(-search, -1)))).withColumn("right", low(F.first(seen, ignorenulls=True).over(order.rowsBetween(1, search))))


def openings(columns: DataFrame, keys: list[str], flag: Column, tolerance: int, width: tuple[int, int]) -> DataFrame:
    """Runs of flagged columns of a width in the band whose both ends are flanked; all columns of
    a run, bridged ones too, with start and stop."""
    order = Window.partitionBy(*keys).orderBy("col")
    flagged = columns.withColumn("__f", F.coalesce(flag, F.lit(False)))
    last = F.last(F.when(F.col("__f"), F.col("col")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = flagged.withColumn("__cut", F.when(F.col("__f") & F.coalesce(F.col("col") - last - 1 > tolerance, F.lit(True)), 1).otherwise(0)).withColumn("__run", F.sum("__cut").over(order))
    again = F.first(F.when(F.col("__f"), F.col("__run")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    inside = opened.withColumn("__again", again).filter((F.col("__run") > 0) & (F.col("__run") == F.col("__again")))
    whole = Window.partitionBy(*keys, "__run")
    ends = inside.withColumn("start", F.min("col").over(whole)).withColumn("stop", F.max("col").over(whole) + 1)
    ok = F.max(F.when(F.col("col") == F.col("start"), F.col("left"))).over(whole) & F.max(F.when(F.col("col") == F.col("stop") - 1, F.col("right"))).over(whole)
    return ends.withColumn("__ok", ok).filter(F.col("__ok") & (F.col("stop") - F.col("start")).between(*width)).drop("__ok", "__cut", "__again", "__run")


def bucket_argmax(rows: DataFrame, keys: list[str], index: str, score: str, stride: int, least: float, most: int) -> DataFrame:
    """Every stride-th row with a score of at least `least`; of more than `most` of these, the best
    of each of `most` equal spans of the index, the earliest of equals. No sort: one aggregation
    for the spans' bounds, one for the winners."""
    kept = rows.filter((F.col(index) % stride == 0) & (F.col(score) >= least))
    bounds = kept.groupBy(*keys).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"), F.count(F.lit(1)).alias("__n"))
    span = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1))
    bucket = F.when(F.col("__n") > most, F.least(F.lit(most - 1), F.floor((F.col(index) - F.col("__lo")) * most / span))).otherwise(F.col(index))
    joined = kept.join(bounds, keys).withColumn("bucket", bucket.cast("long"))
    return joined.groupBy(*keys, "bucket").agg(F.min_by(F.struct(index, score), F.struct(-F.col(score), index)).alias("w")).select(*keys, "bucket", "w.*")


def segments(rows: DataFrame, keys: list[str], index: str, similarity: Column, cut: float) -> DataFrame:
    """rows with segment: a new one starts where the similarity to the row before is below cut."""
    order = Window.partitionBy(*keys).orderBy(index)
    starts = F.when(F.coalesce(similarity < cut, F.lit(False)), 1).otherwise(0)
    return rows.withColumn("__start", starts).withColumn("segment", F.sum("__start").over(order)).drop("__start")


def clusters_1d(rows: DataFrame, keys: list[str], value: str, tie: str, gap: float) -> DataFrame:
    """rows with cluster: sorted by value, a gap to the row before of more than `gap` starts one."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    starts = F.when(F.col(value) - F.lag(value).over(order) > gap, 1).otherwise(0)
    return rows.withColumn("__start", starts).withColumn("cluster", F.sum("__start").over(order)).drop("__start")


def bracketed(rows: DataFrame, keys: list[str], index: str, is_key: Column, offset: Column) -> DataFrame:
    """rows with offset: that of key rows, between them linear in the index, beyond them that of
    the nearest; null in sequences without key rows. One window each way, no join."""
    mark = F.when(is_key, F.struct(F.col(index).alias("at"), offset.alias("of")))
    order = Window.partitionBy(*keys).orderBy(index)
    before = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("__b", before).withColumn("__a", after)
    lo, hi = F.coalesce("__b", "__a"), F.coalesce("__a", "__b")
    share = F.when(hi["at"] > lo["at"], (F.col(index) - lo["at"]) / (hi["at"] - lo["at"])).otherwise(0.0)
    return both.withColumn("offset", lo["of"] + share * (hi["of"] - lo["of"])).drop("__b", "__a")


def keyframes(rows: DataFrame, keys: list[str], index: str, every: int) -> DataFrame:
    """Every `every`-th place of a sequence (counted from 0) and its last."""
    order = Window.partitionBy(*keys).orderBy(index)
    place = F.row_number().over(order) - 1
    last = F.lead(index).over(order).isNull()
    return rows.withColumn("place", place).withColumn("__last", last).filter((F.col("place") % every == 0) | F.col("__last")).drop("__last")


def subtracted(wholes: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """What cuts (start, stop) leave of wholes (lo, hi), one of each key: (start, stop)."""
    inner = wholes.join(cuts, keys).select(*keys, "lo", "hi", F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop")).filter("start < stop")
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo"))
    between = inner.select(*keys, reach.alias("start"), F.col("start").alias("stop"))
    ends = inner.groupBy(*keys, "hi").agg(F.max("stop").alias("start")).select(*keys, "start", F.col("hi").alias("stop"))
    untouched = wholes.join(inner.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("lo").alias("start"), F.col("hi").alias("stop"))
    return between.unionByName(ends).unionByName(untouched).filter("start < stop")


def merged_segments(rows: DataFrame, keys: list[str], index: str, vector: str, cut: float, least: int) -> DataFrame:
    """segments(), then runs shorter than `least` join the more similar neighbour (the one before
    on ties), first short run first, until none is left. The loop is sequential, so each sequence
    is one task's data frame."""
    import numpy as np
    import pandas as pd

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{index} {kinds[index]}", "segment int"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, ignore_index=True)
        unit = np.array(pdf[vector].tolist(), dtype=float)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        alike = (unit[:-1] * unit[1:]).sum(axis=1)
        edges = [0, *(np.flatnonzero(alike < cut) + 1).tolist(), len(unit)]
        at = 0
        while len(edges) > 2:  # everything before `at` is long enough already
            while at < len(edges) - 1 and edges[at + 1] - edges[at] >= least:
                at += 1
            if at >= len(edges) - 1:
                break
            if at == 0:
                drop = 1
            elif at == len(edges) - 2:
                drop = at
            else:
                drop = at if alike[edges[at] - 1] >= alike[edges[at + 1] - 1] else at + 1
            del edges[drop]
            at = max(0, at - 1)
        pdf["segment"] = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype("int32")
        return pdf[[*keys, index, "segment"]]

    return rows.select(*keys, index, vector).groupBy(*keys).applyInPandas(merge, schema)


def spaced_pairs(pairs: DataFrame, keys: list[str], gap: int, most: int | None = None) -> DataFrame:
    """Of pairs (i, j), longest first, then by i and j: those whose i is at least gap // 2 from
    every i taken, `most` at most (None: all of them), with their place. Pairs with a null end are left out; null keys are one key.

    A pair that is taken bars all others of its i, so of each i only the best is kept at the start.
    Then every round takes the best pair of each key and bars its neighbours, for all keys at once;
    there are `most` rounds or fewer. What a round leaves is a table in the shared folder. All of them are
    as many as a key is long, each waiting for those before it: there a key's pairs, one of each i, are one task's data frame."""
    apart = gap // 2
    first = F.struct(-F.abs(F.col("i") - F.col("j")), "i", "j")
    left = pairs.filter("i IS NOT NULL AND j IS NOT NULL").select(*keys, "i", "j")
    if apart < 1:  # nothing bars anything
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(first)) - 1
        return left.withColumn("place", place).filter(F.col("place") < most if most is not None else F.lit(True))
    left = left.groupBy(*keys, "i").agg(F.min_by("j", first).alias("j"))
    if most is None:
        return _spaced(left, keys, apart)
    steps = Steps(pairs.sparkSession, "taken")
    left = steps.keep(left, "left")
    taken = None
    for place in range(most):
        best = left.groupBy(*keys).agg(F.min_by(F.struct("i", "j"), first).alias("__best"))
        best = steps.keep(best.select(*keys, "__best.i", "__best.j", F.lit(place).alias("place")), "taken")
        taken = best if taken is None else taken.union(best)
        chosen = best.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("i").alias("near"))
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        left = left.join(chosen, reduce(and_, same)).filter(F.abs(F.col("i") - F.col("near")) >= apart)
        left = steps.keep(left.select(*keys, "i", "j"), "left")
        if not left.limit(1).count():
            break
    return taken if taken is not None else left.withColumn("place", F.lit(0)).limit(0)


def _spaced(pairs: DataFrame, keys: list[str], apart: int) -> DataFrame:
    """All of spaced_pairs(), of pairs with one j for each i."""
    import numpy as np
    import pandas as pd

    kinds = dict(pairs.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"i {kinds['i']}, j {kinds['j']}, place int"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        low, high = np.searchsorted(i, i - apart, side="right"), np.searchsorted(i, i + apart, side="left")
        free, taken = np.ones(len(i), dtype=bool), []
        for at in np.lexsort((i, -np.abs(i - j))):
            if free[at]:
                taken.append(at)
                free[low[at] : high[at]] = False
        return pdf.loc[taken, [*keys, "i", "j"]].assign(place=np.arange(len(taken), dtype="int32"))

    return pairs.select(*keys, "i", "j").groupBy(*keys).applyInPandas(choose, schema)


def last_near(points: DataFrame, keys: list[str], index: str, axes: list[str], radius: float, gap: int, first: int = 256) -> DataFrame:
    """(keys, i, j): of each point i that has such, the last point j of its key that is at most `radius` away and at least
    `gap` places on. Null keys are one key.

    Points ask about the last `first` or so of their key; those that find none ask about the ones before these, up to four times
    as many in each round, to the start of the key. So where many points are near, few meet, and of the pairs only
    one is kept for each point."""
    axis = [f"__x{n}" for n in range(len(axes))]
    cells = [f"__c{n}" for n in range(len(axes))]
    steps = Steps(points.sparkSession)
    placed = points.select(*keys, F.col(index).alias("i"), *[F.col(a).cast("double").alias(x) for a, x in zip(axes, axis)]).dropna(subset=["i", *axis])
    placed = placed.select("*", *[F.floor(F.col(x) / radius).alias(c) for x, c in zip(axis, cells)])
    ends = placed.groupBy(*keys).agg(F.max("i").alias("__hi"), F.min("i").alias("__lo"), F.count(F.lit(1)).alias("__n"))
    ends = ends.select(*[F.col(k).alias(f"of_{k}") for k in keys], "__hi", (F.col("__hi") - F.col("__lo")).alias("__span"), "__n")
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    placed = placed.join(ends, reduce(and_, same)).select(*placed.columns, (F.col("__hi") - F.col("i")).alias("__back"), "__span", "__n")
    asked = left = steps.keep(placed, "points")
    shifts = [()]
    for _ in axes:
        shifts = [(*s, d) for s in shifts for d in (-1, 0, 1)]
    around = F.explode(F.array(*[F.array(*[F.lit(d) for d in s]) for s in shifts]))
    found, before = None, F.lit(-1)
    while True:
        upto = F.when(F.col("__n") > 4 * first, F.ceil(F.col("__span") * first / F.col("__n"))).otherwise(F.col("__span"))
        late = asked.filter((F.col("__back") > before) & (F.col("__back") <= upto)).withColumn("__s", around)
        late = late.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("i").alias("j"), *[F.col(x).alias(f"of_{x}") for x in axis], *[(F.col(c) + F.col("__s")[n]).alias(f"of_{c}") for n, c in enumerate(cells)])
        distance = F.sqrt(sum(((F.col(x) - F.col(f"of_{x}")) ** 2 for x in axis), F.lit(0.0)))
        met = left.join(late, reduce(and_, [*same, *[F.col(c) == F.col(f"of_{c}") for c in cells]])).filter((distance <= radius) & (F.col("j") - F.col("i") >= gap))
        last = steps.keep(met.groupBy(*keys, "i").agg(F.max("j").alias("j")), f"last-{first}")
        found = last if found is None else found.unionByName(last)
        of = last.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("i").alias("of_i"))
        left = left.join(of, reduce(and_, [*same, F.col("i") == F.col("of_i")]), "left_anti")
        left = steps.keep(left.filter((upto < F.col("__span")) & (F.col("__back") > upto + gap)), "left")
        if not left.limit(1).count():
            return found
        before, first = upto, 4 * first


def longest_near(points: DataFrame, keys: list[str], index: str, axes: list[str], radius: float, gap: int, most: int | None = None, first: int = 256) -> DataFrame:
    """spaced_pairs() of all pairs of a key's points that are at most `radius` and at least `gap` places apart.

    Without `most`, only the longest pair of each point can be taken, so no others are sought (last_near). With it,
    the longest are taken first, so only pairs of at least some length are sought, between the two ends of a key: the
    ends begin with about `first` points and are four times as long in the next round, for those keys that did not find
    `most` pairs. Where many pairs are near, few points meet; where few are, the join of all of them is small."""
    if most is None:
        every = last_near(points, keys, index, axes, radius, gap, first) if gap > 1 else spatial.radius_pairs(points, keys, index, axes, radius, gap)
        return spaced_pairs(every.select(*keys, "i", "j"), keys, gap)
    steps = Steps(points.sparkSession)
    left = steps.keep(points.filter(F.col(index).isNotNull()).groupBy(*keys).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"), F.count(F.lit(1)).alias("__n")), "left")
    found = None
    while True:
        span = F.col("__hi") - F.col("__lo")
        reach = F.when(F.col("__n") > 4 * first, F.ceil(span * first / F.col("__n"))).otherwise(span)
        asked = left.select(*keys, "__lo", "__hi", F.greatest(F.lit(gap), span - reach).alias("__least"), "__n")
        ends = points.join(asked, keys).filter((F.col(index) <= F.col("__hi") - F.col("__least")) | (F.col(index) >= F.col("__lo") + F.col("__least")))
        pairs = spatial.radius_pairs(ends, [*keys, "__least"], index, axes, radius, gap).filter(F.col("j") - F.col("i") >= F.col("__least"))
        taken = spaced_pairs(pairs.select(*keys, "i", "j"), keys, gap, most)
        full = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") >= most)
        short = asked.filter(F.col("__least") > gap).join(full, keys, "left_anti").select(*left.columns)
        left = steps.keep(short, "left")
        done = taken.join(left, keys, "left_anti")
        if not left.limit(1).count():
            return done if found is None else found.unionByName(done)
        done = steps.keep(done, f"done-{first}")
        found = done if found is None else found.unionByName(done)
        first *= 4
