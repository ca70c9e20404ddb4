"""Room-level operators: ceilings, scale cues, wall support, cell arrangements, stitching edges,
cross-checked openings, totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import wrapped
from tesserae.session import Steps

# Fixed values of the measurement protocol, metres.
CEILING_LEAST, CEILING_MOST, CEILING_PRIOR, CEILING_PRIOR_SD = 1.90, 3.40, 2.44, 0.30
DOOR_PRIOR = 2.032
DOOR_WIDTHS, WINDOW_WIDTHS = (0.55, 1.40), (0.35, 2.60)


def ceilings(rooms: DataFrame, tops: DataFrame, keys: list[str], measured: str, top: str) -> DataFrame:
    """Ceiling height per room with its interval and the way it was found: measured; else the
    heights where walls stop, if three or more agree within 0.15; else the middle of the band from
    the highest wall point to a plausible most; else a prior."""
    seen = tops.filter(F.col(top).isNotNull() & ~F.isnan(top)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(top).alias("mid"), F.max(top).alias("hi"), (F.max(top) - F.min(top)).alias("spread"))
    r = rooms.select(*keys, F.col(measured).alias("m")).join(seen, keys, "left")
    agree = (F.col("n") >= 3) & (F.col("spread") <= 0.15) & (F.col("mid") >= CEILING_LEAST)
    lower = F.greatest(F.col("hi"), F.lit(CEILING_LEAST * 0.9))
    upper = F.greatest(F.lit(CEILING_MOST), lower + 0.35)
    pick = lambda a, b, c, d: F.when(F.col("m").isNotNull(), a).when(agree, b).when(F.col("n") > 0, c).otherwise(d)
    return r.select(*keys, pick(F.lit("measured"), F.lit("wall_extrapolation"), F.lit("scan_cutoff_prior"), F.lit("prior")).alias("method"),
                    pick(F.col("m"), F.col("mid") + 0.05, (lower + upper) / 2, F.lit(CEILING_PRIOR)).alias("height"),
                    pick(F.col("m") - 0.03, F.col("mid") - 0.05, lower, F.lit(CEILING_PRIOR - 0.30)).alias("ci_lo"),
                    pick(F.col("m") + 0.03, F.col("mid") + 0.35, upper, F.lit(CEILING_PRIOR + 0.30)).alias("ci_hi"))


def depth_cue(frames: DataFrame, keys: list[str], frame: str, metric: str, local: str, least: int = 50) -> DataFrame:
    """Scale from per-frame ratios of medians, weighted by points; frames of fewer than `least`
    points or without positive depths are left out."""
    positive = lambda c: F.median(F.when(F.col(c) > 0, F.col(c)))
    per = frames.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("n"), (positive(metric) / positive(local)).alias("ratio")).filter((F.col("n") >= least) & (F.col("ratio") > 0))
    g = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("scale"), F.stddev_pop("ratio").alias("s"))
    spread = F.when(F.col("frames") > 1, F.col("s") / F.greatest("scale", F.lit(1e-6))).otherwise(0.15)
    return g.select(*keys, F.lit("metric_depth").alias("cue"), "scale", F.greatest(spread, F.lit(0.08)).alias("sd"))


def door_cue(doors: DataFrame, keys: list[str], pixels: str, focal: str, depth: str) -> DataFrame:
    """Scale from door heights against a prior: the median, never tighter than 0.18."""
    estimate = DOOR_PRIOR / (F.col(pixels) / F.col(focal) * F.col(depth))
    g = doors.filter((F.col(pixels) > 0) & (F.col(depth) > 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median(estimate).alias("scale"), F.stddev_pop(estimate).alias("s"))
    spread = F.when(F.col("n") > 1, F.col("s") / F.greatest("scale", F.lit(1e-6))).otherwise(0.20)
    return g.select(*keys, F.lit("door_height").alias("cue"), "scale", F.greatest(spread, F.lit(0.18)).alias("sd"))


def ceiling_cue(rooms: DataFrame, keys: list[str], span: str) -> DataFrame:
    return rooms.filter(F.col(span) > 0).select(*keys, F.lit("ceiling_height").alias("cue"), (CEILING_PRIOR / F.col(span)).alias("scale"), F.lit(CEILING_PRIOR_SD / CEILING_PRIOR).alias("sd"))


def wall_cells(points: DataFrame, walls: DataFrame, keys: list[str], band: float, cell: float) -> DataFrame:
    """Cells (keys, wall, col, row, n) of points x, y, h in the band of walls (ax, ay, bx, by, top);
    the bounds are closed and the last cell takes its upper edge. A point is in one square of the floor
    and meets only the walls that pass it."""
    side = F.greatest(F.lit(8 * band), F.lit(4 * cell))
    w = walls.withColumn("__len", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).filter("__len > 0")
    for n, (p, q) in enumerate((("ax", "bx"), ("ay", "by"))):
        w = w.withColumn(f"__g{n}", F.explode(F.sequence(F.floor((F.least(p, q) - 2 * band) / side), F.floor((F.greatest(p, q) + 2 * band) / side))))
    # of the squares in a slanted wall's box only those that it passes
    off = lambda c, n: (F.col(f"__g{n}") + 0.5) * side - F.col(c)
    passed = F.abs(off("ay", 1) * (F.col("bx") - F.col("ax")) - off("ax", 0) * (F.col("by") - F.col("ay"))) / F.col("__len") <= side + 2 * band
    j = points.withColumn("__g0", F.floor(F.col("x") / side)).withColumn("__g1", F.floor(F.col("y") / side)).join(w.filter(passed), [*keys, "__g0", "__g1"])
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("__len"), (F.col("by") - F.col("ay")) / F.col("__len")
    dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along, across = dx * ux + dy * uy, dy * ux - dx * uy
    inside = (F.abs(across) <= band) & along.between(0, F.col("__len")) & F.col("h").between(0, F.col("top"))
    place = lambda v, most: F.least(F.floor(v / cell), F.greatest(F.ceil(most / cell) - 1, F.lit(0)))
    return j.filter(inside).groupBy(*keys, "wall", place(along, F.col("__len")).alias("col"), place(F.col("h"), F.col("top")).alias("row")).agg(F.count(F.lit(1)).alias("n"))


def line_support(points: DataFrame, lines: DataFrame, keys: list[str], band: float, least: int, height: float = 0.5) -> DataFrame:
    """(keys, line, n, top): points close to axis lines (axis 0: x = coord; lo, hi along the other),
    high enough; the 98th percentile of their heights, for lines with enough points. A point is in one
    strip of each axis and meets only the lines of that strip."""
    strip = 2 * band
    placed = lines.withColumn("__s", F.explode(F.sequence(F.floor((F.col("coord") - band) / strip - 1e-6), F.floor((F.col("coord") + band) / strip + 1e-6))))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("x").alias("at"), F.col("y").alias("along")), F.struct(F.lit(1).alias("axis"), F.col("y").alias("at"), F.col("x").alias("along"))))
    sided = points.filter(F.col("h") >= height).select(*keys, "h", sides.alias("p")).select(*keys, "h", "p.*").withColumn("__s", F.floor(F.col("at") / strip))
    j = sided.join(placed, [*keys, "axis", "__s"])
    perp, along = F.col("at") - F.col("coord"), F.col("along")
    near = (F.abs(perp) <= band) & along.between(F.col("lo"), F.col("hi"))
    return j.filter(near).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("n"), F.percentile("h", 0.98).alias("top")).filter(F.col("n") >= least)


def nearest_line(walls: DataFrame, lines: DataFrame, keys: list[str], most: float) -> DataFrame:
    """(keys, wall, line, distance): the closest line of a wall's orientation, the first of equals. Walls and lines of a key are
    sorted once; a wall looks no further than the line before it and the line after it."""
    vertical = F.abs(F.col("bx") - F.col("ax")) < 0.3 * F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    flat = F.abs(F.col("by") - F.col("ay")) < 0.3 * F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    w = walls.withColumn("__axis", F.when(vertical, 0).when(flat, 1))
    middle = F.when(F.col("__axis") == 0, (F.col("ax") + F.col("bx")) / 2).otherwise((F.col("ay") + F.col("by")) / 2)
    asked = w.withColumn("__m", middle).filter(F.col("__m").isNotNull() & F.col("__axis").isNotNull()).select(*keys, "__axis", F.col("__m").alias("__at"), "wall", F.lit(None).cast(dict(lines.dtypes)["line"]).alias("line"))
    shown = lines.groupBy(*keys, F.col("axis").alias("__axis"), F.col("coord").cast("double").alias("__at")).agg(F.min("line").alias("line")).filter("__at is not null and __axis is not null")
    both = asked.unionByName(shown.withColumn("wall", F.lit(None).cast(dict(walls.dtypes)["wall"])))
    # the nearest line on either side is the last before a wall or the first after it in order of place
    line = F.when(F.col("line").isNotNull(), F.struct("__at", "line"))
    beside = F.array(*[F.last(line, ignorenulls=True).over(Window.partitionBy(*keys, "__axis").orderBy(way).rangeBetween(Window.unboundedPreceding, 0)) for way in (F.asc("__at"), F.desc("__at"))])
    seen = both.withColumn("__b", beside).filter(F.col("wall").isNotNull())
    for k in keys:
        seen = seen.filter(F.col(k).isNotNull())
    met = seen.select(*keys, "wall", "__at", F.explode("__b").alias("b"))
    d = F.abs(F.col("__at") - F.col("b.__at"))
    return met.filter(F.col("b").isNotNull()).withColumn("distance", d).filter(F.col("distance") <= most).groupBy(*keys, "wall").agg(F.min(F.struct("distance", F.col("b.line").alias("line"))).alias("b")).select(*keys, "wall", "b.line", "b.distance")


def nearest_seen(pixels: DataFrame, points: DataFrame, keys: list[str], pixel: str, point: str, cutoff: float = 40.0, first: float = 2.5) -> DataFrame:
    """(keys, pixel, point, distance): for each pixel (keys, pixel, u, v) the nearest point that the same frame shows
    (keys, point, u, v), the first of equals; pixels with none within `cutoff` have no row.

    Rings grow: cells of `first` pixels, then of twice that, up to the cut-off. What lies within a cell's side of a pixel is in
    its cell or the eight about it, so a match that near is the nearest, and only pixels without one go on to the
    next, wider cells: dense frames are settled in narrow ones."""
    steps = Steps(pixels.sparkSession)
    left = steps.keep(pixels.select(*keys, pixel, "u", "v").filter("u is not null and v is not null"), "left")
    shown = points.select(*keys, point, F.col("u").alias("__u"), F.col("v").alias("__v")).filter("__u is not null and __v is not null")
    found, size = [], min(first, cutoff)
    while True:
        about = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        asked = left.withColumn("__o", about).withColumn("__x", cell("u") + F.col("__o.a")).withColumn("__y", cell("v") + F.col("__o.b"))
        d = F.sqrt((F.col("u") - F.col("__u")) ** 2 + (F.col("v") - F.col("__v")) ** 2)
        near = asked.join(shown.withColumn("__x", cell("__u")).withColumn("__y", cell("__v")), [*keys, "__x", "__y"]).withColumn("distance", d).filter(F.col("distance") <= size)
        hit = near.groupBy(*keys, pixel).agg(F.min(F.struct("distance", point)).alias("b")).select(*keys, pixel, f"b.{point}", "b.distance")
        found.append(steps.keep(hit, f"found-{len(found)}"))
        if size >= cutoff:
            break
        left = steps.keep(left.join(found[-1], [*keys, pixel], "left_anti"), "left")
        size = min(2 * size, cutoff)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cell_arrangement(cuts: DataFrame, floor: DataFrame, path: DataFrame, keys: list[str], cell: float, coverage: float = 0.30, least: float = 0.20) -> DataFrame:
    """Cells between consecutive cuts (keys, axis, at) of both axes that were walked through, or of
    which at least `coverage` is floor cells (cx, cy); small ones go. A point finds its
    cell in its key's two sorted arrays of cuts, so no point meets a cell that is not its own."""
    of = lambda axis: F.sort_array(F.collect_set(F.when(F.col("axis") == axis, F.col("at"))))
    sorted_cuts = cuts.groupBy(*keys).agg(of(0).alias("__u"), of(1).alias("__v"))  # a few cuts a key
    centre = floor.select(*keys, ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"), F.lit(0).alias("walk"))
    both = centre.unionByName(path.select(*keys, "x", "y", F.lit(1).alias("walk"))).join(sorted_cuts, keys)
    up_to = lambda place: lambda c: c <= place
    for cut, at, name in (("__u", "x", "u"), ("__v", "y", "v")):
        below = F.size(F.filter(cut, up_to(F.col(at))))  # cuts up to the point
        both = both.withColumn(f"{name}0", F.get(cut, below - 1)).withColumn(f"{name}1", F.get(cut, below))
    sized = both.filter((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")) >= least)  # null outside the cuts
    hit = sized.groupBy(*keys, "u0", "u1", "v0", "v1").agg(F.count_if(F.col("walk") == 0).alias("filled"), F.max("walk").alias("walk"))
    share = F.col("filled") * cell * cell / ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))
    return hit.withColumn("share", share).filter((F.col("walk") == 1) | (F.col("share") >= coverage))


def doorway_transforms(pairs: DataFrame) -> DataFrame:
    """pairs with yaw, tx, ty that put room b's door (bx, by, normal bnx, bny) onto room a's, with
    the normals facing each other."""
    yaw = wrapped(F.atan2("any", "anx") + F.pi() - F.atan2("bny", "bnx"))
    out = pairs.withColumn("yaw", yaw)
    return out.withColumn("tx", F.col("ax") - (F.cos("yaw") * F.col("bx") - F.sin("yaw") * F.col("by"))).withColumn("ty", F.col("ay") - (F.sin("yaw") * F.col("bx") + F.cos("yaw") * F.col("by")))


def stitch_edges(pairs: DataFrame, inliers: str, doorway: str, least: int = 4, each: float = 0.15, most: float = 8.0, door: float = 3.0) -> DataFrame:
    """pairs with source, confidence and reason: key points with enough inliers, a doorway, or both;
    else rejected with a reason."""
    keypoints, has = F.coalesce(F.col(inliers), F.lit(0)) >= least, F.coalesce(F.col(doorway), F.lit(False))
    source = F.when(keypoints & has, "keypoints+doorway").when(keypoints, "keypoints").when(has, "doorway")
    base = F.least(F.lit(most), each * F.col(inliers))
    confidence = F.when(keypoints & has, F.least(base + door, F.lit(2 * most))).when(keypoints, base).when(has, F.lit(door))
    reason = F.when(source.isNull(), F.when(F.col(inliers) > 0, F.format_string("only %d key points, no doorway", inliers)).otherwise("no key points, no doorway"))
    return pairs.withColumn("source", source).withColumn("confidence", confidence).withColumn("reason", reason)


def cross_checked(geometric: DataFrame, semantic: DataFrame, keys: list[str], share: float = 0.40) -> DataFrame:
    """Openings of both sources (keys name a wall; place, kind, start, stop, score): in order of
    place, a geometric one claims the first semantic one not claimed yet that shares enough of the
    shorter; unclaimed semantic ones of a plausible width follow. The claim is sequential, so a
    wall is one task's data frame."""
    kinds = dict(geometric.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "kind string, start double, stop double, score double, sources string, note string"])

    def run(key: tuple, geo: pd.DataFrame, sem: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(), []
        # a side without rows comes without columns
        geo, sem = (x.sort_values("place", ignore_index=True) if len(x) else pd.DataFrame() for x in (geo, sem))
        # only what starts before an opening ends, and less than the longest one earlier, can reach into it
        first, last = (sem[c].to_numpy(float) for c in ("start", "stop")) if len(sem) else (np.zeros(0), np.zeros(0))
        order = np.argsort(first, kind="stable")
        first, last, free = first[order], last[order], np.ones(len(order), dtype=bool)
        longest = np.nanmax(last - first, initial=0)
        kinds_of, scores_of = (sem[c].to_numpy() for c in ("kind", "score")) if len(sem) else ((), ())
        for g in geo.itertuples():
            score, sources, note = g.score, "geometry", ""
            lo, hi = np.searchsorted(first, g.start - longest - 1e-9 * (abs(g.start) + longest)), np.searchsorted(first, g.stop, side="right")
            shorter = np.minimum(g.stop - g.start, last[lo:hi] - first[lo:hi])
            shared = np.minimum(g.stop, last[lo:hi]) - np.maximum(g.start, first[lo:hi])
            with np.errstate(divide="ignore", invalid="ignore"):
                fits = np.flatnonzero(free[lo:hi] & (shorter > 0) & (shared / shorter >= share))
            if fits.size:
                at = lo + fits[order[lo + fits].argmin()]
                i, free[at] = int(order[at]), False
                taken.add(i)
                score, sources = min(0.97, g.score + 0.15 * scores_of[i]), "geometry+semantic"
                note = "" if kinds_of[i] == g.kind else f"{g.kind} or {kinds_of[i]}"
            rows.append((*key, g.kind, g.start, g.stop, score, sources, note))
        for i, s in enumerate(sem.itertuples()):
            low, high = DOOR_WIDTHS if s.kind == "door" else WINDOW_WIDTHS
            if i not in taken and low <= s.stop - s.start <= high:
                rows.append((*key, s.kind, s.start, s.stop, s.score * 0.8, "semantic", ""))
        return pd.DataFrame(rows, columns=[*keys, "kind", "start", "stop", "score", "sources", "note"])

    columns = [*keys, "place", "kind", "start", "stop", "score"]
    # columns of their own for each side, which may be two parts of one table
    left, right = (df.select(*[F.col(c).alias(c) for c in columns]) for df in (geometric, semantic))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def evenly_sampled(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """Groups of more than `most` rows thinned to every ceil(n / most)-th in order: a sampling
    operator."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return rows.withColumn("__place", place).join(n, keys).filter(F.col("__place") % F.ceil(F.col("__n") / most) == 0).drop("__place", "__n")


def box_grid(boxes: DataFrame, steps: int = 7, low: float = 0.12, high: float = 0.88, least: float = 12.0) -> DataFrame:
    """boxes (x0, y0, x1, y1) of at least `least` pixels a side with u, v of a steps by steps grid."""
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * (low + (high - low) * F.col(i) / (steps - 1))
    big = boxes.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    n = F.explode(F.sequence(F.lit(0), F.lit(steps * steps - 1)))
    g = big.withColumn("__n", n).withColumn("__i", F.col("__n") % steps).withColumn("__j", F.floor(F.col("__n") / steps))
    return g.withColumn("u", at("x0", "x1", "__i")).withColumn("v", at("y0", "y1", "__j")).drop("__n", "__i", "__j")


def point_normals(points: DataFrame, keys: list[str], index: str, axes: tuple[str, str, str], radius: float, most: int = 30) -> DataFrame:
    """(keys, index, nx, ny, nz, neighbours): the direction of least spread of the nearest `most`
    points within the radius, null for fewer than three. Points meet in blocks of eight radii with
    a margin of one radius, so a task holds a block, not a cloud."""
    side = 8 * radius
    block = [F.floor(F.col(a) / side) for a in axes]
    shifts = F.explode(F.array(*[F.array(*[F.lit(d) for d in s]) for s in np.ndindex(3, 3, 3)]))
    sent = points.select(*keys, index, *axes).withColumn("__s", shifts)
    for n, a in enumerate(axes):
        sent = sent.withColumn(f"__b{n}", block[n] + F.col("__s")[n] - 1)
    close = F.lit(True)
    for n, a in enumerate(axes):
        close = close & (F.col(a) >= F.col(f"__b{n}") * side - radius) & (F.col(a) <= (F.col(f"__b{n}") + 1) * side + radius)
    sent = sent.filter(close).withColumn("__own", (F.col("__s")[0] == 1) & (F.col("__s")[1] == 1) & (F.col("__s")[2] == 1)).drop("__s")
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{index} {kinds[index]}, nx double, ny double, nz double, neighbours int"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[list(axes)].to_numpy(float)
        own = np.flatnonzero(pdf["__own"].to_numpy(bool))
        rows = []
        for i in own:
            d = ((p - p[i]) ** 2).sum(axis=1)
            near = np.flatnonzero(d <= radius * radius)
            if near.size > most:
                near = near[np.lexsort((pdf[index].to_numpy()[near], d[near]))[:most]]
            if near.size < 3:
                rows.append((np.nan, np.nan, np.nan, near.size))
                continue
            q = p[near] - p[near].mean(axis=0)
            v = np.linalg.eigh(q.T @ q)[1][:, 0]
            v *= np.sign(v[np.abs(v).argmax()])
            rows.append((*v, near.size))
        out = pdf.iloc[own][[*keys, index]].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(rows, columns=["nx", "ny", "nz", "neighbours"])], axis=1).astype({"neighbours": "int32"}) if len(out) else pd.DataFrame(columns=[*keys, index, "nx", "ny", "nz", "neighbours"])

    return sent.groupBy(*keys, "__b0", "__b1", "__b2").applyInPandas(run, schema)


def boundary_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (x0, y0, x1, y1) of the union of cells (u0, u1, v0, v1) of one arrangement, directed
    with the inside on the left: an edge that two cells share is met in both directions and goes."""
    e = lambda a, b, c, d, s: F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1"), F.lit(s).alias("way"))
    edges = F.explode(F.array(e("u0", "v0", "u1", "v0", 1), e("u1", "v0", "u1", "v1", 1), e("u0", "v1", "u1", "v1", -1), e("u0", "v0", "u0", "v1", -1)))
    counted = cells.select(*keys, edges.alias("e")).select(*keys, "e.*").groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.sum("way").alias("way")).filter("way <> 0")
    back = F.col("way") < 0
    return counted.select(*keys, F.when(back, F.col("x1")).otherwise(F.col("x0")).alias("x0"), F.when(back, F.col("y1")).otherwise(F.col("y0")).alias("y0"), F.when(back, F.col("x0")).otherwise(F.col("x1")).alias("x1"), F.when(back, F.col("y0")).otherwise(F.col("y1")).alias("y1"))


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, place, x, y): boundary edges chained into rings without collinear vertices; at a
    vertex of two ways the sharpest left turn is taken, so touching parts stay apart."""
    kinds = dict(edges.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "ring int, place int, x double, y double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, list[tuple]] = {}
        for a in pdf.sort_values(["x0", "y0", "x1", "y1"]).itertuples():
            out.setdefault((a.x0, a.y0), []).append((a.x1, a.y1))
        found, ring = [], 0
        while any(out.values()):
            start = min(p for p, to in out.items() if to)
            at, path = start, []
            before = None
            while True:
                ways = out[at]
                if before is not None and len(ways) > 1:
                    turn = lambda to: np.arctan2((at[0] - before[0]) * (to[1] - at[1]) - (at[1] - before[1]) * (to[0] - at[0]), (at[0] - before[0]) * (to[0] - at[0]) + (at[1] - before[1]) * (to[1] - at[1]))  # noqa: B023, E731
                    to = max(ways, key=turn)
                else:
                    to = ways[0]
                ways.remove(to)
                path.append(at)
                before, at = at, to
                if at == start:
                    break
            n = len(path)
            corners = [p for i, p in enumerate(path) if (p[0] - path[i - 1][0]) * (path[(i + 1) % n][1] - p[1]) != (p[1] - path[i - 1][1]) * (path[(i + 1) % n][0] - p[0])]
            found += [(*key, ring, i, x, y) for i, (x, y) in enumerate(corners)]
            ring += 1
        return pd.DataFrame(found, columns=[*keys, "ring", "place", "x", "y"]).astype({"ring": "int32", "place": "int32"})

    return edges.select(*keys, "x0", "y0", "x1", "y1").groupBy(*keys).applyInPandas(run, schema)
