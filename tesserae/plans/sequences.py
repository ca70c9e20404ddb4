"""Sequences and histograms over events, customers and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import cosine
from tesserae.operators import histogram, sequence
from tesserae.plans.registry import Tables, query

_HOURS = "h AS (SELECT DISTINCT user_id, (epoch(ts) / 3600)::bigint - 473352 AS hour FROM (SELECT user_id, date_trunc('hour', ts) AS ts FROM events))"


def _hours(t: Tables) -> DataFrame:
    """Hours from 2024-01-01 with an event, per user."""
    return t.events.select("user_id", (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long").alias("hour")).distinct()


@query(f"""
WITH {_HOURS},
g AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) - 1 <= 2 THEN 0 ELSE 1 END AS cut FROM h),
r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY hour) AS run FROM g)
SELECT user_id, min(hour) AS start, max(hour) + 1 AS stop, count(*) AS n FROM r GROUP BY user_id, run
""")
def gaps_islands_tol(t: Tables) -> DataFrame:
    return sequence.runs(_hours(t), ["user_id"], "hour", 2)


@query(f"""
WITH {_HOURS}
SELECT a.user_id, min(a.hour) AS first FROM h a JOIN h b ON a.user_id = b.user_id AND b.hour = a.hour + 1 JOIN h c ON a.user_id = c.user_id AND c.hour = a.hour + 2 GROUP BY a.user_id
""")
def first_sustained(t: Tables) -> DataFrame:
    return sequence.first_sustained(_hours(t), ["user_id"], "hour", 3)


@query(f"""
WITH {_HOURS}, g AS (SELECT user_id, hour AS high, lag(hour) OVER (PARTITION BY user_id ORDER BY hour) AS p FROM h)
SELECT user_id, p + 1 AS low, high FROM g WHERE high - p > 1
""")
def interior_gaps(t: Tables) -> DataFrame:
    return sequence.interior_gaps(_hours(t), ["user_id"], "hour")


_GRID = """
cells AS (SELECT event_type, day(ts)::int - 1 AS col, hour(ts)::int AS row FROM events GROUP BY ALL HAVING max(value) > 40),
spine AS (SELECT event_type, unnest(range(30))::int AS col FROM (SELECT DISTINCT event_type FROM cells)),
seen AS (SELECT event_type, col, count(*) AS filled FROM cells GROUP BY 1, 2),
firsts AS (SELECT a.event_type, a.col, min(a.row) AS first FROM cells a JOIN cells b ON a.event_type = b.event_type AND a.col = b.col AND b.row = a.row + 1 JOIN cells c ON a.event_type = c.event_type AND a.col = c.col AND c.row = a.row + 2 GROUP BY 1, 2),
cols AS (SELECT event_type, col, coalesce(filled >= 3, false) AS observed, CASE WHEN filled >= 3 THEN coalesce(first, 24) ELSE 24 END AS clearance FROM spine LEFT JOIN seen USING (event_type, col) LEFT JOIN firsts USING (event_type, col)),
flank AS (SELECT *, coalesce(last_value(CASE WHEN observed THEN clearance END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY col ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) <= 7, false) AS lft,
                 coalesce(first_value(CASE WHEN observed THEN clearance END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY col ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) <= 7, false) AS rgt FROM cols)"""


def _grid(t: Tables) -> DataFrame:
    """Days as columns and hours as rows of one grid for each event type."""
    cells = t.events.groupBy("event_type", (F.dayofmonth("ts") - 1).alias("col"), F.hour("ts").alias("row")).agg(F.max("value").alias("v"))
    return cells.filter("v > 40").drop("v")


@query(f"WITH {_GRID} SELECT event_type, col, observed, clearance, lft AS \"left\", rgt AS \"right\" FROM flank")
def column_clearance(t: Tables) -> DataFrame:
    return sequence.flanked(sequence.columns_of(_grid(t), ["event_type"], 30, 24), ["event_type"], 7, 6)


@query(f"""
WITH {_GRID},
f AS (SELECT event_type, col, CASE WHEN col - lag(col) OVER (PARTITION BY event_type ORDER BY col) - 1 <= 2 THEN 0 ELSE 1 END AS cut FROM cols WHERE observed AND clearance >= 8),
r AS (SELECT event_type, min(col) AS start, max(col) + 1 AS stop FROM (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY col) AS run FROM f) GROUP BY event_type, run),
k AS (SELECT r.* FROM r JOIN flank a ON a.event_type = r.event_type AND a.col = start JOIN flank b ON b.event_type = r.event_type AND b.col = stop - 1 WHERE a.lft AND b.rgt AND stop - start BETWEEN 1 AND 10)
SELECT k.event_type, start, stop, round(median(clearance), 3) AS head, round(least(0.95::double, greatest(0.3::double, 1 - (max(clearance) - min(clearance)) * 0.05::double)), 6) AS confidence
FROM k JOIN cols c ON c.event_type = k.event_type AND c.col >= start AND c.col < stop GROUP BY k.event_type, start, stop
""")
def door_runs(t: Tables) -> DataFrame:
    columns = sequence.flanked(sequence.columns_of(_grid(t), ["event_type"], 30, 24), ["event_type"], 7, 6)
    inside = sequence.openings(columns, ["event_type"], F.col("observed") & (F.col("clearance") >= 8), 2, (1, 10))
    spread = F.max("clearance") - F.min("clearance")
    return inside.groupBy("event_type", "start", "stop").agg(F.round(F.median("clearance"), 3).alias("head"), F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.3), 1 - spread * 0.05)), 6).alias("confidence"))


@query(f"""
WITH {_GRID},
g AS (SELECT event_type, col, row AS high, lag(row) OVER (PARTITION BY event_type, col ORDER BY row) + 1 AS low FROM cells),
b AS (SELECT event_type, col, low, high, row_number() OVER (PARTITION BY event_type, col ORDER BY high - low DESC, low) AS place FROM g JOIN cols USING (event_type, col) WHERE high - low >= 3 AND low >= 4 AND observed),
f AS (SELECT event_type, col, CASE WHEN col - lag(col) OVER (PARTITION BY event_type ORDER BY col) - 1 <= 2 THEN 0 ELSE 1 END AS cut FROM b WHERE place = 1),
r AS (SELECT event_type, min(col) AS start, max(col) + 1 AS stop FROM (SELECT *, sum(cut) OVER (PARTITION BY event_type ORDER BY col) AS run FROM f) GROUP BY event_type, run),
k AS (SELECT r.* FROM r JOIN flank x ON x.event_type = r.event_type AND x.col = start JOIN flank y ON y.event_type = r.event_type AND y.col = stop - 1 WHERE x.lft AND y.rgt AND stop - start BETWEEN 1 AND 20)
SELECT k.event_type, start, stop, round(median(low), 3) AS sill, round(median(high), 3) AS head FROM k JOIN b ON b.event_type = k.event_type AND b.col >= start AND b.col < stop AND place = 1
GROUP BY k.event_type, start, stop HAVING count(*) >= 2 AND max(low) - min(low) <= 4
""")
def window_runs(t: Tables) -> DataFrame:
    cells = _grid(t)
    columns = sequence.flanked(sequence.columns_of(cells, ["event_type"], 30, 24), ["event_type"], 7, 6)
    gaps = sequence.interior_gaps(cells, ["event_type", "col"], "row").filter("high - low >= 3 AND low >= 4")
    best = gaps.groupBy("event_type", "col").agg(F.min_by(F.struct("low", "high"), F.struct(F.col("low") - F.col("high"), "low")).alias("b")).select("event_type", "col", "b.*")
    joined = columns.join(best, ["event_type", "col"], "left")
    inside = sequence.openings(joined, ["event_type"], F.col("observed") & F.col("low").isNotNull(), 2, (1, 20))
    inside = inside.withColumn("low", F.when(F.col("observed"), F.col("low")))
    out = inside.groupBy("event_type", "start", "stop").agg(F.count("low").alias("n"), (F.max("low") - F.min("low")).alias("spread"), F.round(F.median("low"), 3).alias("sill"), F.round(F.median("high"), 3).alias("head"))
    return out.filter("n >= 2 AND spread <= 4").drop("n", "spread")


@query("""
WITH k AS (SELECT event_type, event_id, value FROM events WHERE event_id % 3 = 0 AND value >= 1.0),
b AS (SELECT event_type, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM k GROUP BY 1),
x AS (SELECT k.*, (CASE WHEN n > 8 THEN least(7, floor((event_id - lo) * 8 / greatest(hi - lo, 1))) ELSE event_id END)::bigint AS bucket FROM k JOIN b USING (event_type))
SELECT event_type, bucket, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value DESC, event_id) AS r FROM x) WHERE r = 1
""")
def bucket_argmax(t: Tables) -> DataFrame:
    return sequence.bucket_argmax(t.events, ["event_type"], "event_id", "value", 3, 1.0, 8)


_COSINE = """p AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS d FROM embeddings),
s AS (SELECT label, vec_id, list_cosine_similarity(e::double[], d::double[]) AS c FROM p)"""


def _alike(t: Tables) -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return t.embeddings.withColumn("d", before).withColumn("c", F.when(F.col("d").isNotNull(), cosine(F.col("embedding"), F.col("d"))))


@query(f"WITH {_COSINE} SELECT label, vec_id, sum(CASE WHEN c < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::bigint AS segment FROM s")
def segment_sequence(t: Tables) -> DataFrame:
    return sequence.segments(_alike(t), ["label"], "vec_id", F.col("c"), 0.0).select("label", "vec_id", "segment")


@query()
def segment_merge(t: Tables) -> DataFrame:
    return sequence.merged_segments(t.embeddings, ["label"], "vec_id", "embedding", 0.0, 2)


@query("""
WITH g AS (SELECT *, CASE WHEN c_acctbal - lag(c_acctbal) OVER w > 60 THEN 1 ELSE 0 END AS cut FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS cluster FROM g)
SELECT c_nationkey, cluster::bigint AS cluster, count(*) AS n, round(sum(round(c_acctbal * 100)::bigint * (c_custkey % 7 + 1))::double / sum(c_custkey % 7 + 1)::double, 4) AS coord_cents, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c GROUP BY 1, 2
""")
def line_cluster(t: Tables) -> DataFrame:
    rows = sequence.clusters_1d(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey", 60.0)
    w = F.col("c_custkey") % 7 + 1
    return rows.groupBy("c_nationkey", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("c_acctbal") * 100).cast("long") * w) / F.sum(w), 4).alias("coord_cents"), F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))


@query("""
WITH m AS (SELECT user_id, event_id, value, CASE WHEN event_id % 10 = 0 THEN event_id END AS kf FROM events),
b AS (SELECT *, last_value(kf IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
               first_value(kf IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM m),
j AS (SELECT b.user_id, b.event_id, x.event_id AS lo, y.event_id AS hi, x.value AS lov, y.value AS hiv FROM b LEFT JOIN events x ON x.event_id = coalesce(p, n) LEFT JOIN events y ON y.event_id = coalesce(n, p))
SELECT user_id, event_id, round(lov + CASE WHEN hi > lo THEN (event_id - lo) / (hi - lo) ELSE 0 END * (hiv - lov), 6) AS "offset" FROM j
""")
def asof_interpolate(t: Tables) -> DataFrame:
    out = sequence.bracketed(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("event_id") % 10 == 0, F.col("value"))
    return out.select("user_id", "event_id", F.round("offset", 6).alias("offset"))


@query("""
WITH s AS (SELECT *, abs(value - lag(value) OVER w) AS step, row_number() OVER w AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n, round(coalesce(sum(step), 0), 4) AS length, round(abs(max(value) FILTER (a = 1) - max(value) FILTER (z = 1)), 4) AS end_gap, round(coalesce(max(step), 0), 4) AS max_step, round(avg((value > 20)::int), 6) AS above FROM s GROUP BY user_id
""")
def path_stats(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t.events.withColumn("step", F.abs(F.col("value") - F.lag("value").over(order)))
    at = F.struct("ts", "event_id")
    return steps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 4).alias("length"), F.round(F.abs(F.min_by("value", at) - F.max_by("value", at)), 4).alias("end_gap"),
                                        F.round(F.coalesce(F.max("step"), F.lit(0.0)), 4).alias("max_step"), F.round(F.avg((F.col("value") > 20).cast("double")), 6).alias("above"))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS fin FROM events),
k AS (SELECT user_id, place, event_id, value FROM p WHERE place % 10 = 0 OR fin)
SELECT user_id, place, event_id, round(lead(value) OVER w - value, 6) AS moved, round(pmod - pi(), 6) AS turned FROM (
  SELECT *, (x - floor(x / (2 * pi())) * (2 * pi())) AS pmod FROM (SELECT *, lead(value) OVER w - value + pi() AS x FROM k WINDOW w AS (PARTITION BY user_id ORDER BY place))) WINDOW w AS (PARTITION BY user_id ORDER BY place)
""")
def keyframe_steps(t: Tables) -> DataFrame:
    from tesserae.functions.geometry import wrapped

    rows = t.events.select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("o"))
    kept = sequence.keyframes(rows, ["user_id"], "o", 10)
    moved = F.lead("value").over(Window.partitionBy("user_id").orderBy("place")) - F.col("value")
    return kept.withColumn("m", moved).select("user_id", F.col("place").cast("long").alias("place"), "event_id", F.round("m", 6).alias("moved"), F.round(wrapped(F.col("m")), 6).alias("turned"))


@query(f"""
WITH {_HOURS},
w AS (SELECT user_id, min(hour) AS lo, max(hour) + 1 AS hi FROM h GROUP BY 1),
c AS (SELECT user_id, greatest(hour - 1, lo) AS start, least(hour + 3, hi) AS stop, lo, hi FROM h JOIN w USING (user_id) WHERE hour % 3 = 0),
b AS (SELECT user_id, coalesce(max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS start, start AS stop FROM c WHERE start < stop)
SELECT * FROM (SELECT user_id, start, stop FROM b UNION ALL SELECT user_id, max(stop), any_value(hi) FROM c GROUP BY user_id UNION ALL SELECT user_id, lo, hi FROM w WHERE user_id NOT IN (SELECT user_id FROM c)) WHERE start < stop
""")
def interval_subtraction(t: Tables) -> DataFrame:
    hours = _hours(t)
    wholes = hours.groupBy("user_id").agg(F.min("hour").alias("lo"), (F.max("hour") + 1).alias("hi"))
    cuts = hours.filter("hour % 3 = 0").select("user_id", (F.col("hour") - 1).alias("start"), (F.col("hour") + 3).alias("stop"))
    return sequence.subtracted(wholes, cuts, ["user_id"])


_BINS = """b AS (SELECT event_type, floor((value - lo) / 5) AS bin, count(*) AS n, any_value(lo) AS lo FROM events JOIN (SELECT event_type, min(value) AS lo FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2),
s AS (SELECT event_type, bin::bigint AS bin, n, lo + (bin + 0.5::double) * 5 AS centre, n >= 0.2::double * max(n) OVER (PARTITION BY event_type) AS supported FROM b)"""


@query(f"WITH {_BINS} SELECT event_type, bin, n, round(centre, 6) AS centre, supported FROM s")
def height_histogram(t: Tables) -> DataFrame:
    return histogram.height_bins(t.events, ["event_type"], "value", 5.0, 0.2).withColumn("centre", F.round("centre", 6))


@query(f"WITH {_BINS} SELECT event_type, round(min(centre), 6) AS floor, round(max(centre), 6) AS ceiling, count(*) AS planes FROM s WHERE supported GROUP BY event_type")
def height_hist_seed(t: Tables) -> DataFrame:
    out = histogram.height_seeds(histogram.height_bins(t.events, ["event_type"], "value", 5.0, 0.2), ["event_type"])
    return out.select("event_type", F.round("floor", 6).alias("floor"), F.round("ceiling", 6).alias("ceiling"), "planes")


@query("""
WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS total, greatest(1, ceil((max(value) - min(value)) / 2.5::double)) AS bins FROM events GROUP BY 1),
c AS (SELECT event_type, lo, hi, total, bins, least(bins - 1, floor((value - lo) / ((hi - lo) / bins))) AS bin, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY ALL),
e AS (SELECT event_type, lo, hi, bins, min(bin) FILTER (n >= 0.5::double * total / bins) AS f, max(bin) FILTER (n >= 0.5::double * total / bins) AS l FROM c GROUP BY 1, 2, 3, 4)
SELECT event_type, round(coalesce(lo + f * ((hi - lo) / bins), lo), 6) AS low, round(coalesce(lo + (l + 1) * ((hi - lo) / bins), hi), 6) AS high FROM e
""")
def densest_edge(t: Tables) -> DataFrame:
    out = histogram.densest_edge(t.events, ["event_type"], "value", 2.5)
    return out.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
