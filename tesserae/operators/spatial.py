"""Spatial operators: joins by cells instead of nested loops, circular means, fits by sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import geometry
from tesserae.session import Steps


def radius_pairs(points: DataFrame, keys: list[str], index: str, axes: list[str], radius: float, apart: int = 1) -> DataFrame:
    """(keys, i, j, distance): unordered pairs of one key, i < j, at most `radius` apart and with
    indexes at least `apart` apart. Each point is sent to the cells around it (half of them; the
    other half comes from its partner), so the join is an equality on cells; the exact test follows."""
    dims = range(len(axes))
    cells = [f"__c{n}" for n in dims]
    base = points.select(*keys, F.col(index).alias("__i"), *[F.col(a).cast("double").alias(f"__x{n}") for n, a in enumerate(axes)], *[F.floor(F.col(a) / radius).alias(c) for a, c in zip(axes, cells)])
    shifts = [()]
    for _ in axes:
        shifts = [(*s, d) for s in shifts for d in (-1, 0, 1)]
    near = F.explode(F.array(*[F.array(*[F.lit(d) for d in s]) for s in shifts if s >= (0,) * len(axes)]))
    sent = base.withColumn("__s", near).select(*keys, F.col("__i").alias("__j"), *[F.col(f"__x{n}").alias(f"__y{n}") for n in dims], *[(F.col(c) + F.col("__s")[n]).alias(c) for n, c in enumerate(cells)], F.array_max(F.transform("__s", F.abs)).alias("__moved"))
    pairs = base.join(sent, [*keys, *cells])
    distance = F.sqrt(sum(((F.col(f"__x{n}") - F.col(f"__y{n}")) ** 2 for n in dims), F.lit(0.0)))
    # pairs of one cell meet twice, pairs of two cells once
    once = (F.col("__moved") > 0) | (F.col("__i") < F.col("__j"))
    pairs = pairs.withColumn("distance", distance).filter((F.col("distance") <= radius) & (F.abs(F.col("__i") - F.col("__j")) >= apart) & once)
    return pairs.select(*keys, F.least("__i", "__j").alias("i"), F.greatest("__i", "__j").alias("j"), "distance")


def ratio_pairs(rows: DataFrame, keys: list[str], index: str, value: str, tolerance: float) -> DataFrame:
    """(keys, a, b): pairs of one key, a < b, whose positive values differ by at most tolerance of
    the larger. Distinct values of a key meet in logarithmic buckets, with neighbours one bucket up; rows then meet
    over the values that are close, so that no two rows meet that are not a pair."""
    step = -math.log(1 - tolerance)
    sound = rows.filter(F.col(value) > 0).select(*keys, F.col(index).alias("__a"), F.col(value).alias("__x"))
    base = sound.select(*keys, "__x").distinct().withColumn("__k", F.floor(F.log("__x") / step))
    other = base.withColumn("__d", F.explode(F.array(F.lit(0), F.lit(1)))).select(*keys, F.col("__x").alias("__y"), (F.col("__k") - F.col("__d")).alias("__k"), "__d")
    close = F.abs(F.col("__x") - F.col("__y")) <= tolerance * F.greatest("__x", "__y")
    values = base.join(other, [*keys, "__k"]).filter(close & ((F.col("__d") == 1) | (F.col("__x") <= F.col("__y")))).select(*keys, "__x", "__y")
    pairs = sound.join(values, [*keys, "__x"]).join(sound.select(*keys, F.col("__a").alias("__b"), F.col("__x").alias("__y")), [*keys, "__y"])
    pairs = pairs.filter((F.col("__x") != F.col("__y")) | (F.col("__a") < F.col("__b")))
    return pairs.select(*keys, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))


def block_pairs(rows: DataFrame, keys: list[str], index: str, size: int = 4096) -> DataFrame:
    """rows with __p, __q and __own: the rows of a key are dealt into blocks of about `size`, and each pair of blocks (p <= q) is a
    group, so that all pairs of a key meet in tasks of bounded memory. __own: the row is of block p; in a block's own pair all are."""
    counts = Steps(rows.sparkSession).keep(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__blocks")), "counts")
    dealt = (rows.join(counts, keys) if keys else rows.crossJoin(F.broadcast(counts))).withColumn("__b", F.pmod(F.xxhash64(index), F.col("__blocks")).cast("int"))
    sent = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    sent = sent.select(*rows.columns, F.least("__b", "__o").alias("__p"), F.greatest("__b", "__o").alias("__q"), (F.col("__b") <= F.col("__o")).alias("__own"))
    # a pair of blocks is little to ship and much to compute: adaptive execution would put many into one task
    groups = counts.agg(F.sum(F.expr("__blocks * (__blocks + 1L) / 2"))).first()[0] or 1
    return sent.repartition(int(min(max(groups, 1), 2000)), *keys, "__p", "__q")


def alike_pairs(rows: DataFrame, keys: list[str], index: str, vector: str, least: float) -> DataFrame:
    """(keys, a, b, similarity): pairs of one key, a < b, whose vectors have a cosine of at least `least`; null vectors are in none.
    All pairs are compared, block by block, as products of matrices; those near the limit are summed again in doubles, as a column would."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"a {kinds[index]}, b {kinds[index]}, similarity double"])
    sound = rows.filter(F.col(vector).isNotNull() & F.col(index).isNotNull()).select(*keys, index, F.col(vector).cast("array<double>").alias("__v"), F.size(vector).alias("__d"))
    columns = [*keys, "a", "b", "similarity"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["__own"].to_numpy(bool)
        left, right = pdf[own].sort_values(index), (pdf if key[-3] == key[-2] else pdf[~own]).sort_values(index)
        names = [x[index].to_numpy() for x in (left, right)]
        x, y = (np.array(part["__v"].tolist(), dtype=float).reshape(len(part), -1) for part in (left, right))
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        found = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for lo in range(0, len(x), 512):
                rough = (x[lo : lo + 512] @ y.T) / np.sqrt(xx[lo : lo + 512, None] * yy[None, :])
                i, j = np.nonzero(~(rough < least - 1e-9))  # not a number passes here, as it passes in SQL
                i = i + lo
                if key[-3] == key[-2]:
                    i, j = i[names[0][i] < names[1][j]], j[names[0][i] < names[1][j]]
                s = np.cumsum(x[i] * y[j], axis=1)[:, -1] / np.sqrt(np.cumsum(x * x, axis=1)[i, -1] * np.cumsum(y * y, axis=1)[j, -1])
                keep = ~(s < least)
                a, b = names[0][i[keep]], names[1][j[keep]]
                found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s[keep]}))
        out = pd.concat(found) if found else pd.DataFrame(columns=columns[-3:])
        for k, v in zip(reversed(keys), reversed(key[: len(keys)])):
            out.insert(0, k, v)
        return out[columns]

    return block_pairs(sound, keys, index).groupBy(*keys, "__p", "__q", "__d").applyInPandas(run, schema)


def circular_mean(rows: DataFrame, keys: list[str], angle: Column, weight: Column | None = None, fold: int = 4) -> DataFrame:
    """Mean direction modulo 2 pi / fold and the length of the resultant; (0, 0) for no weight."""
    w = F.lit(1.0) if weight is None else weight
    s, c, total = F.sum(w * F.sin(fold * angle)), F.sum(w * F.cos(fold * angle)), F.sum(w)
    some = total > 0
    return rows.groupBy(*keys).agg(F.when(some, F.atan2(s, c) / fold).otherwise(0.0).alias("angle"), F.when(some, F.sqrt(s * s + c * c) / total).otherwise(0.0).alias("resultant"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median: the first value whose running weight reaches half of the total.
    Equal values are summed first, so only distinct values are sorted."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    running = F.sum("__w").over(Window.partitionBy(*keys).orderBy(value))
    total = F.sum("__w").over(Window.partitionBy(*keys))
    return sums.withColumn("__r", running).withColumn("__t", total).filter(F.col("__r") >= F.col("__t") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def combined_scale(cues: DataFrame, keys: list[str], value: str, sd: str) -> DataFrame:
    """Cues that fired (a positive value) to one scale with its interval and agreement; a key whose
    cues did not fire has scale 1, interval (0.4, 2.5) and agreement 0."""
    fired = cues.filter((F.col(value) > 0) & F.col(sd).isNotNull()).withColumn("__w", F.greatest(1 / F.greatest(F.col(sd), F.lit(1e-4)) ** 2, F.lit(1.0)))
    middle = weighted_median(fired, keys, value, "__w")
    stats = fired.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("__sd"), F.max(sd).alias("__one"), (F.sum(F.col("__w") * F.col(sd)) / F.sum("__w")).alias("__own"))
    spread = F.when(F.col("n") > 1, F.col("__sd") / F.greatest("median", F.lit(1e-6))).otherwise(F.col("__one"))
    out = stats.join(middle, keys).withColumn("__spread", spread)
    half = 1.96 * F.greatest("__own", "__spread")
    half = F.when(F.col("n") == 1, F.greatest(half, F.lit(0.30))).otherwise(half)
    agreement = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("__spread") / 0.5))).otherwise(0.3)
    out = out.select(*keys, "n", F.col("median").alias("scale"), (F.col("median") * (1 - half)).alias("ci_lo"), (F.col("median") * (1 + half)).alias("ci_hi"), agreement.alias("agreement"))
    every = cues.select(*keys).distinct().join(out, keys, "left")
    return every.select(*keys, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n", 0), ("scale", 1.0), ("ci_lo", 0.4), ("ci_hi", 2.5), ("agreement", 0.0))])


def procrustes(pairs: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], weight: str) -> DataFrame:
    """Weighted rigid transform of b onto a per key: yaw, tx, ty, n. In two dimensions it is closed
    form in five weighted sums, so one aggregation does it; means are taken off afterwards."""
    w = F.col(weight)
    s = lambda x: F.sum(w * x)
    ax, ay, bx, by = (F.col(c) for c in (*a, *b))
    sums = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), s(ax).alias("ax"), s(ay).alias("ay"), s(bx).alias("bx"), s(by).alias("by"),
                                    s(bx * ax).alias("xx"), s(by * ay).alias("yy"), s(bx * ay).alias("xy"), s(by * ax).alias("yx"))
    m = {c: F.col(c) / F.col("w") for c in ("ax", "ay", "bx", "by", "xx", "yy", "xy", "yx")}
    cos_part = (m["xx"] - m["bx"] * m["ax"]) + (m["yy"] - m["by"] * m["ay"])
    sin_part = (m["xy"] - m["bx"] * m["ay"]) - (m["yx"] - m["by"] * m["ax"])
    out = sums.withColumn("yaw", F.atan2(sin_part, cos_part))
    c, si = F.cos("yaw"), F.sin("yaw")
    return out.select(*keys, "n", "yaw", (m["ax"] - (c * m["bx"] - si * m["by"])).alias("tx"), (m["ay"] - (si * m["bx"] + c * m["by"])).alias("ty"))


def procrustes_refit(pairs: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], weight: str, limit: float, least: int = 3) -> DataFrame:
    """A fit on all pairs, then one on those within `limit` of it; inliers of the second fit.
    Keys with fewer than `least` pairs or inliers have none."""
    def residual(fit: DataFrame) -> DataFrame:
        j = pairs.join(fit.drop("n"), keys)
        x = F.cos("yaw") * F.col(b[0]) - F.sin("yaw") * F.col(b[1]) + F.col("tx") - F.col(a[0])
        y = F.sin("yaw") * F.col(b[0]) + F.cos("yaw") * F.col(b[1]) + F.col("ty") - F.col(a[1])
        return j.withColumn("__r", F.sqrt(x * x + y * y)).filter(F.col("__r") <= limit)

    kept = residual(procrustes(pairs, keys, a, b, weight).filter(F.col("n") >= least)).drop("yaw", "tx", "ty", "__r")
    again = procrustes(kept, keys, a, b, weight).filter(F.col("n") >= least)
    j = kept.join(again.drop("n"), keys)
    x = F.cos("yaw") * F.col(b[0]) - F.sin("yaw") * F.col(b[1]) + F.col("tx") - F.col(a[0])
    y = F.sin("yaw") * F.col(b[0]) + F.cos("yaw") * F.col(b[1]) + F.col("ty") - F.col(a[1])
    inliers = j.groupBy(*keys).agg(F.count_if(F.sqrt(x * x + y * y) <= limit).alias("inliers"))
    return again.join(inliers, keys).drop("n")


def plane_fit(points: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """Least squares z = a x + b y + c per key, from centred second moments; null if degenerate."""
    cov = lambda p, q: F.covar_pop(p, q)
    m = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cov(x, x).alias("xx"), cov(y, y).alias("yy"), cov(x, y).alias("xy"), cov(x, z).alias("xz"), cov(y, z).alias("yz"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.when(det > 1e-15, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)
    b = F.when(det > 1e-15, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return m.withColumn("a", a).withColumn("b", b).select(*keys, "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def ring_measures(vertices: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Area, perimeter and centroid of a closed ring of ordered vertices."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead(x).over(w), F.first(x).over(whole)), F.coalesce(F.lead(y).over(w), F.first(y).over(whole))
    e = vertices.withColumn("nx", nx).withColumn("ny", ny).withColumn("cross", F.col(x) * F.col("ny") - F.col("nx") * F.col(y))
    step = F.sqrt((F.col("nx") - F.col(x)) ** 2 + (F.col("ny") - F.col(y)) ** 2)
    out = e.groupBy(*keys).agg((F.sum("cross") / 2).alias("s"), F.sum(step).alias("perimeter"), F.sum((F.col(x) + F.col("nx")) * F.col("cross")).alias("sx"), F.sum((F.col(y) + F.col("ny")) * F.col("cross")).alias("sy"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", F.abs("s").alias("area"), "perimeter", F.try_divide(F.col("sx"), 6 * F.col("s")).alias("cx"), F.try_divide(F.col("sy"), 6 * F.col("s")).alias("cy"))


def corner_vertices(vertices: DataFrame, keys: list[str], order: str, x: str, y: str, least: float) -> DataFrame:
    """Vertices whose corner with both neighbours (cross product of the unit directions times the
    shorter side) is above `least`; collinear ones go."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertices
    for c in (x, y):
        v = v.withColumn(f"n{c}", F.coalesce(F.lead(c).over(w), F.first(c).over(whole))).withColumn(f"p{c}", F.coalesce(F.lag(c).over(w), F.last(c).over(whole)))
    ax, ay, bx, by = F.col(x) - F.col(f"p{x}"), F.col(y) - F.col(f"p{y}"), F.col(f"n{x}") - F.col(x), F.col(f"n{y}") - F.col(y)
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    turn = F.abs(F.try_divide(ax * by - ay * bx, la * lb)) * F.least(la, lb)
    return v.filter(turn > least).drop(f"n{x}", f"p{x}", f"n{y}", f"p{y}")


def box_overlaps(boxes: DataFrame, index: str, cell: float) -> DataFrame:
    """(a, b, area) of boxes (x0, y0, x1, y1) that overlap, a < b; boxes with a null or endless corner overlap none.

    A box lies on the level whose cells (`cell` times a power of two) are the first at least as long as its longer side, so it
    touches four cells at most. It is looked up there and on every coarser level that has boxes, of which there are as many as
    powers of two between the least and the greatest side: a box over a whole town costs no more than any other. Two boxes meet
    on the coarser one's level, and the cell of the overlap's lower corner reports them, once."""
    corners = ("x0", "y0", "x1", "y1")
    sound = boxes.select(F.col(index).alias("id"), *corners).filter(geometry.finite(*[F.col(c) for c in corners]))
    longer = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(cell))
    level = F.ceil(F.log2(longer / cell)).cast("int")
    # rounding may put a side of just over a power of two one level too low: it then touches a cell more
    own = sound.withColumn("level", level)
    levels = own.agg(F.collect_set("level").alias("levels"))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    spread = lambda df: df.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    right_way = own.filter("x0 <= x1 AND y0 <= y1")
    everywhere = right_way.withColumnRenamed("level", "lowest").crossJoin(levels).withColumn("level", F.explode("levels")).filter("level >= lowest").drop("levels")
    mine = spread(right_way).select("level", "gx", "gy", F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in corners])
    theirs = spread(everywhere).select("level", "gx", "gy", F.col("id").alias("b"), "lowest", *[F.col(c).alias(f"b_{c}") for c in corners])
    pairs = mine.join(theirs, ["level", "gx", "gy"]).filter("a <> b AND (lowest < level OR a < b)")
    lo_x, lo_y = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - lo_x, F.least("a_y1", "b_y1") - lo_y
    once = (F.floor(lo_x / size) == F.col("gx")) & (F.floor(lo_y / size) == F.col("gy"))
    return pairs.filter(once & (w > 0) & (h > 0)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (w * h).alias("area"))


def overlap_counts(boxes: DataFrame, index: str) -> DataFrame:
    """(a, n, worst): for each box (x0, y0, x1, y1) that overlaps boxes of a greater index, how many and the largest shared area. For
    boxes that lie so densely that their pairs cannot be written: these are counted where two blocks of boxes meet."""
    corners = ("x0", "y0", "x1", "y1")
    kinds = dict(boxes.dtypes)
    sound = boxes.select(F.col(index).alias("id"), *[F.col(c).cast("double").alias(c) for c in corners]).filter(geometry.finite(*[F.col(c) for c in corners])).filter("x0 < x1 AND y0 < y1 AND id IS NOT NULL")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["__own"].to_numpy(bool)
        sides = [pdf[own], pdf if key[0] == key[1] else pdf[~own]]
        ids = [side["id"].to_numpy() for side in sides]
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ([side[c].to_numpy(float) for c in corners] for side in sides)
        # boxes sorted by their left side: those that start beyond the right ends of some are not looked at
        order, place = np.argsort(ax0, kind="stable"), np.argsort(bx0, kind="stable")
        bx0, by0, bx1, by1, b = bx0[place], by0[place], bx1[place], by1[place], ids[1][place]
        n, worst = [np.zeros(len(i), dtype=np.int64) for i in ids], [np.zeros(len(i)) for i in ids]
        for lo in range(0, len(order), 8):  # few at a time: what they meet stays in the cache
            at = order[lo : lo + 8]
            upto = int(np.searchsorted(bx0, ax1[at].max(), side="left"))
            w = np.minimum(ax1[at, None], bx1[None, :upto]) - np.maximum(ax0[at, None], bx0[None, :upto])
            h = np.minimum(ay1[at, None], by1[None, :upto]) - np.maximum(ay0[at, None], by0[None, :upto])
            on, area = (w > 0) & (h > 0), w * h
            first = ids[0][at, None] < b[None, :upto]
            mine = on & first
            n[0][at] += mine.sum(axis=1)
            worst[0][at] = np.maximum(worst[0][at], np.where(mine, area, 0).max(axis=1, initial=0))
            if key[0] != key[1]:
                theirs = on & ~first
                n[1][place[:upto]] += theirs.sum(axis=0)
                worst[1][place[:upto]] = np.maximum(worst[1][place[:upto]], np.where(theirs, area, 0).max(axis=0, initial=0))
        out = pd.DataFrame({"a": np.concatenate(ids), "n": np.concatenate(n), "worst": np.concatenate(worst)})
        return out[out["n"] > 0]

    met = block_pairs(sound, [], "id").groupBy("__p", "__q").applyInPandas(run, f"a {kinds[index]}, n long, worst double")
    return met.groupBy("a").agg(F.sum("n").alias("n"), F.max("worst").alias("worst"))


def union_area(boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Area of the union of boxes, in cells whose centres are covered: distinct strips of a row are
    merged as intervals, so only rows are spread, not cells."""
    at = lambda c: F.ceil(F.col(c) / cell - 0.5).cast("long")
    rows = boxes.select(*keys, at("x0").alias("s"), at("x1").alias("e"), at("y0").alias("r0"), (at("y1") - 1).alias("r1")).filter("s < e AND r0 <= r1")
    rows = rows.withColumn("row", F.explode(F.sequence("r0", "r1")))
    before = Window.partitionBy(*keys, "row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.col("s"))))
    return rows.withColumn("fresh", fresh).groupBy(*keys).agg((F.sum("fresh") * cell * cell).alias("area"))


def placed_in_line(boxes: DataFrame, order: str, gap: float) -> DataFrame:
    """Shifts that put boxes edge to edge along x, in order, centred in y: one row of sums, in one task,
    for the few boxes that a drawing shows side by side."""
    before = F.coalesce(F.sum(F.col("x1") - F.col("x0") + gap).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return boxes.withColumn("dx", before - F.col("x0")).withColumn("dy", -(F.col("y0") + F.col("y1")) / 2)


def overlapping_sets(rows: DataFrame, index: str, member: str, share: float, wide: int = 32) -> DataFrame:
    """(a, b, shared, share): pairs of sets, a < b, that share a member and at least `share` of the smaller one.
    Null members and null sets take no part.

    A smaller set of n members that must share t of them has one of the shared ones among its rarest n - t + 1,
    so only those look for larger sets. Sets of at most `wide` members bring them along: a pair is judged where it meets, at the
    rarest member that both have, and only pairs that count are written. Candidates for wider sets are counted member by
    member. A member of every set stands last in each and is looked up only by sets so small that it alone is a share."""
    steps = Steps(rows.sparkSession)
    w = rows.select(F.col(index).alias("s"), F.col(member).alias("m")).filter("s IS NOT NULL AND m IS NOT NULL").distinct()
    often = w.groupBy("m").agg(F.count(F.lit(1)).alias("f"))
    # Members of one set alone are the rarest and lead nowhere.
    sets = w.join(often, "m").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.when(F.col("f") > 1, F.struct("f", "m")))).alias("__m"))
    sets = steps.keep(sets.select("s", "n", F.greatest(F.lit(1), F.ceil(F.col("n") * share)).cast("int").alias("need"), F.transform("__m", lambda x: x["m"]).alias("met")).filter(F.size("met") > 0), "sets")
    rarest = F.slice("met", 1, F.greatest(F.size("met") - F.col("need") + 1, F.lit(0)))
    rare = lambda df, *more: df.select(F.explode(rarest).alias("m"), F.col("s").alias("small"), F.col("n").alias("n_small"), *more)
    others = lambda df, *more: df.select(F.explode("met").alias("m"), F.col("s").alias("large"), F.col("n").alias("n_large"), *more)
    larger = "n_small < n_large OR n_small = n_large AND small < large"
    narrow = sets.filter(F.col("n") <= wide)
    both = F.array_intersect("met_small", "met_large")
    judged = rare(narrow, F.col("met").alias("met_small")).join(others(narrow, F.col("met").alias("met_large")), "m").filter(larger).withColumn("both", both)
    judged = judged.filter((F.get("both", F.lit(0)) == F.col("m")) & (F.size("both") >= share * F.col("n_small"))).select("small", "large", "n_small", F.size("both").cast("long").alias("shared"))
    broad = sets.filter(F.col("n") > wide)
    if broad.limit(1).count():
        pairs = rare(sets).join(others(broad), "m").filter(larger).select("small", "large", "n_small").distinct()
        members = sets.select(F.col("s").alias("small"), F.explode("met").alias("m"))
        held = broad.select(F.col("s").alias("large"), F.explode("met").alias("m"))
        counted = pairs.join(members, "small").join(held, ["large", "m"]).groupBy("small", "large", "n_small").agg(F.count(F.lit(1)).alias("shared"))
        judged = judged.unionByName(counted.filter(F.col("shared") >= share * F.col("n_small")))
    a, b = F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b")
    return judged.select(a, b, "shared", (F.col("shared") / F.col("n_small")).alias("share"))
