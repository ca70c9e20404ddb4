"""Gates, coverage, calibration and integrity over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.measure import contains, half_width, in_quadrature, is_valid, relative, relative_half_width, rescaled, symmetric, view_uncertainty, within
from tesserae.operators import assignment, calibration, gates
from tesserae.plans.registry import Tables, query


def _rows(t: Tables, data: list, schema: str) -> DataFrame:
    return t.spark.createDataFrame(data, schema)


LIMITS = [("A", 1000.0, 0.40, 0.50), ("N", 2000.0, 0.30, 0.90), ("R", 500.0, 0.60, 0.40), ("X", 1.0, 0.01, 0.95)]

_PAIRS = """p AS (SELECT l_returnflag AS tier, l_extendedprice AS predicted, l_quantity * p_retailprice AS truth FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _price_pairs(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("tier"), F.col("l_extendedprice").alias("predicted"), (F.col("l_quantity") * F.col("p_retailprice")).alias("truth"))


@query(f"""
WITH {_PAIRS},
lim(tier, a, r, f) AS (VALUES ('A', 1000.0, 0.40, 0.50), ('N', 2000.0, 0.30, 0.90), ('R', 500.0, 0.60, 0.40), ('X', 1.0, 0.01, 0.95)),
g AS (SELECT tier, count(*) AS n, count(*) FILTER (abs(predicted - truth) <= greatest(a::double, r::double * abs(truth)) + 1e-9) AS passed, max(abs(predicted - truth)) AS worst FROM p JOIN lim USING (tier) GROUP BY tier)
SELECT tier, coalesce(n, 0) AS n, coalesce(passed, 0) AS passed, round(passed / n, 6) AS share, round(worst, 4) AS worst,
       CASE WHEN n IS NULL THEN 'SKIP' WHEN passed / n >= f::double - 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status
FROM lim LEFT JOIN g USING (tier)
""")
def tolerance_gate(t: Tables) -> DataFrame:
    limits = _rows(t, LIMITS, "tier string, abs_tol double, rel_tol double, fraction double")
    out = gates.tolerance_gate(_price_pairs(t), limits)
    return out.select("tier", "n", "passed", F.round("share", 6).alias("share"), F.round("worst", 4).alias("worst"), "status")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS place FROM lineitem),
m AS (SELECT o_orderpriority, o_orderkey, abs(o_totalprice / 10000 - v) AS err, o_totalprice / 10000 AS p, v FROM orders JOIN t ON o_orderkey = k AND place = 1)
SELECT o_orderpriority, count(*) AS n, bool_and(err <= greatest(20.0, 0.9::double * abs(v)) + 1e-9) AS passed, round(max(err), 4) AS worst,
       (SELECT o_orderkey FROM m x WHERE x.o_orderpriority = m.o_orderpriority ORDER BY err DESC, o_orderkey LIMIT 1) AS worst_element
FROM m GROUP BY o_orderpriority
""")
def all_pass_gate(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "v", "l_extendedprice")]
    pairs = gates.matched(t.orders.select("o_orderpriority", F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 10000).alias("p")), lines, ["k"], order)
    error = F.abs(F.col("p") - F.col("v"))
    out = gates.all_pass_gate(pairs, ["o_orderpriority"], within(F.col("p"), F.col("v"), F.lit(20.0), F.lit(0.9)), error, F.col("k"))
    return out.withColumn("worst", F.round("worst", 4))


@query("""
WITH p AS (SELECT DISTINCT doc_id, lang FROM documents WHERE n_chars >= 1500),
t AS (SELECT DISTINCT l.doc_id, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality = 1),
j AS (SELECT coalesce(p.lang, t.lang) AS lang, p.doc_id AS pid, t.doc_id AS tid FROM p FULL JOIN t ON p.doc_id = t.doc_id AND p.lang = t.lang)
SELECT lang, count(*) FILTER (pid IS NOT NULL AND tid IS NOT NULL) AS matched, count(*) FILTER (pid IS NULL) AS missed, count(*) FILTER (tid IS NULL) AS phantom,
       round(count(*) FILTER (pid IS NOT NULL AND tid IS NOT NULL) / count(*), 6) AS fraction
FROM j WHERE lang IN (SELECT lang FROM t) GROUP BY lang
""")
def detection_gate(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "n_chars")
    truth = t.labels.filter("quality = 1").join(docs, "doc_id").select("doc_id", "lang")
    out = gates.detection_gate(docs.filter("n_chars >= 1500").select("doc_id", "lang"), truth, ["doc_id"], "lang")
    return out.withColumn("fraction", F.round("fraction", 6))


_SAMPLES = """
a AS (SELECT 'line' AS kind, l_returnflag AS tier, l_extendedprice AS v, 0.8 AS r FROM lineitem
      UNION ALL SELECT 'order', o_orderstatus, o_totalprice, 0.5 FROM orders
      UNION ALL SELECT 'event', event_type, value, 0.9 FROM events),
m AS (SELECT kind, tier, median(v) AS truth FROM a GROUP BY kind, tier),
s AS (SELECT kind, tier, v, abs(v) * r::double AS half_width, truth, abs(v - truth) AS error FROM a JOIN m USING (kind, tier))"""


def _samples(t: Tables) -> DataFrame:
    part = lambda df, kind, tier, value, rel: df.select(F.lit(kind).alias("kind"), F.col(tier).alias("tier"), relative(F.col(value), F.lit(rel)).alias("m"))
    rows = part(t.lineitem, "line", "l_returnflag", "l_extendedprice", 0.8).unionByName(part(t.orders, "order", "o_orderstatus", "o_totalprice", 0.5)).unionByName(part(t.events, "event", "event_type", "value", 0.9))
    truth = calibration.exact_quantiles(rows.select("kind", "tier", F.col("m.value").alias("v")), ["kind", "tier"], "v", 0.5, "truth")
    joined = rows.join(truth, ["kind", "tier"])
    return joined.select("kind", "tier", "m", "truth", half_width(F.col("m")).alias("half_width"), F.abs(F.col("m.value") - F.col("truth")).alias("error"))


@query(f"""
WITH {_SAMPLES}
SELECT kind, tier, count(*) AS n, round(avg((truth BETWEEN v - half_width - 1e-9 AND v + half_width + 1e-9)::int), 6) AS coverage, round(avg(half_width), 3) AS mean_half_width,
       CASE WHEN avg((truth BETWEEN v - half_width - 1e-9 AND v + half_width + 1e-9)::int) >= 0.9 - 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status
FROM s GROUP BY kind, tier
""")
def interval_coverage_by_kind(t: Tables) -> DataFrame:
    covered = F.avg(contains(F.col("m"), F.col("truth")).cast("double"))
    out = _samples(t).groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"), covered.alias("c"), F.avg("half_width").alias("w"))
    return out.select("kind", "tier", "n", F.round("c", 6).alias("coverage"), F.round("w", 3).alias("mean_half_width"), gates.status_of(F.col("n"), F.col("c") >= 0.9 - 1e-9).alias("status"))


_FACTORS = f"""{_SAMPLES},
q AS (SELECT *, CASE WHEN half_width > 0 THEN error / half_width WHEN error <= 1e-9 THEN 0.0 ELSE 'infinity'::double END AS required FROM s),
w AS (SELECT kind, tier, quantile_cont(required, 0.95) FILTER (required < 'infinity'::double) AS raw FROM q GROUP BY kind, tier),
f AS (SELECT kind, tier, raw, coalesce(least(6.0, greatest(1.0, raw)), 1.0)::double AS factor FROM w),
c AS (SELECT kind, tier, count(*) AS n, max(raw) AS raw, max(factor) AS factor, avg((required <= factor + 1e-9 AND raw IS NOT NULL)::int) AS coverage FROM q JOIN f USING (kind, tier) GROUP BY kind, tier)"""


@query(f"WITH {_FACTORS} SELECT kind, tier, n, round(raw, 6) AS raw, round(factor, 6) AS factor, round(coverage, 6) AS coverage, n >= 3 AS trusted FROM c")
def calibration_fit(t: Tables) -> DataFrame:
    out = calibration.fit_factors(_samples(t), ["kind", "tier"])
    return out.select("kind", "tier", "n", *[F.round(c, 6).alias(c) for c in ("raw", "factor", "coverage")], "trusted")


@query(f"""
WITH {_FACTORS}
SELECT kind, count(*) AS n, round(avg((error <= half_width + 1e-9)::int), 6) AS before, round(avg((error <= half_width * factor + 1e-9)::int), 6) AS after, round(avg(half_width * factor), 3) AS mean_half_width
FROM s JOIN c USING (kind, tier) GROUP BY kind
""")
def recalibrate(t: Tables) -> DataFrame:
    samples = _samples(t).withColumn("was", F.col("half_width"))
    wide = calibration.recalibrated(samples, calibration.fit_factors(samples, ["kind", "tier"]), ["kind", "tier"])
    ok = lambda half: F.avg((F.col("error") <= F.col(half) + 1e-9).cast("double"))
    return wide.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(ok("was"), 6).alias("before"), F.round(ok("half_width"), 6).alias("after"), F.round(F.avg("half_width"), 3).alias("mean_half_width"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(v, 4) AS value, round(lo, 4) AS ci_lo, round(hi, 4) AS ci_hi, lo <= v AND v <= hi AS valid,
       round(CASE WHEN v <> 0 THEN (hi - lo) / 2 / abs(v) END, 6) AS rel
FROM (SELECT *, l_extendedprice AS v, l_extendedprice - abs(l_quantity) * 1.5::double AS lo, l_extendedprice + abs(l_quantity) * 1.5::double AS hi FROM lineitem)
""")
def measurement_intervals(t: Tables) -> DataFrame:
    m = rescaled(symmetric(F.col("l_extendedprice"), F.col("l_quantity")), F.lit(1.5))
    rows = t.lineitem.withColumn("m", m)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("m.value", 4).alias("value"), F.round("m.ci_lo", 4).alias("ci_lo"), F.round("m.ci_hi", 4).alias("ci_hi"), is_valid(F.col("m")).alias("valid"), F.round(relative_half_width(F.col("m")), 6).alias("rel"))


_GATES = """
g AS (SELECT o_orderkey, o_orderstatus AS status3, o_orderpriority AS device, 'total' AS gate, o_totalprice AS value, false AS higher FROM orders
      UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'lines', n::double, true FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)),
r AS (SELECT *, CASE WHEN value IS NULL THEN 'SKIP' WHEN (higher AND value >= 3) OR (NOT higher AND value <= 300000) THEN 'PASS' ELSE 'FAIL' END AS status FROM g)"""


def _gate_rows(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    orders = t.orders.join(lines, "o_orderkey", "left")
    both = F.explode(F.array(F.struct(F.lit("total").alias("gate"), F.col("o_totalprice").alias("value"), F.lit(False).alias("higher")), F.struct(F.lit("lines").alias("gate"), F.col("n").alias("value"), F.lit(True).alias("higher"))))
    rows = orders.select("o_orderkey", F.col("o_orderstatus").alias("status3"), F.col("o_orderpriority").alias("device"), both.alias("g")).select("*", "g.*").drop("g")
    ok = F.when(F.col("higher"), F.col("value") >= 3).otherwise(F.col("value") <= 300000)
    return rows.withColumn("status", F.when(F.col("value").isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL"))


@query(f"""
WITH {_GATES}
SELECT status3, device, gate, count(*) FILTER (status <> 'SKIP') AS n_scored, round(avg((status = 'PASS')::int) FILTER (status <> 'SKIP'), 6) AS pass_rate,
       round(CASE WHEN bool_or(higher) THEN min(value) FILTER (status <> 'SKIP') ELSE max(value) FILTER (status <> 'SKIP') END, 2) AS worst
FROM r GROUP BY status3, device, gate
""")
def device_matrix(t: Tables) -> DataFrame:
    out = gates.device_matrix(_gate_rows(t), ["status3", "device", "gate"], "value", "status", F.col("higher"))
    return out.withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("worst", F.round("worst", 2))


@query(f"WITH {_GATES} SELECT gate, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'SKIP') AS skip FROM r GROUP BY gate")
def status_summary(t: Tables) -> DataFrame:
    return _gate_rows(t).groupBy("gate").agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("pass", "fail", "skip")])


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS lo, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS hi,
                  count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer),
g AS (SELECT c_nationkey, c_mktsegment, any_value(n) AS n, max(c_acctbal) FILTER (lo = 1) AS a, max(c_acctbal) FILTER (hi = 1) AS b, max(c_custkey) FILTER (lo = 1) AS low_key, max(c_custkey) FILTER (hi = 1) AS high_key FROM c WHERE n > 1 GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, n, round(b - a, 2) AS spread, low_key, high_key, b - a <= greatest(5000.0, 0.5::double * greatest(abs(a), abs(b))) + 1e-9 AS passed FROM g
""")
def repeat_spread(t: Tables) -> DataFrame:
    out = gates.repeat_spread(t.customer, ["c_nationkey", "c_mktsegment"], "c_acctbal", "c_custkey", 5000.0, 0.5)
    return out.withColumn("spread", F.round("spread", 2))


@query("""
WITH a AS (SELECT s_nationkey AS k, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier),
b AS (SELECT c_nationkey AS k, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer)
SELECT coalesce(a.k, b.k) AS nation, count(*) AS pairs, round(sum(abs(a.v - b.v)), 2) AS cost, bool_and(coalesce(abs(a.v - b.v) <= greatest(0.01::double, 0.005::double * greatest(abs(a.v), abs(b.v))) + 1e-9, false)) AS passed
FROM a FULL JOIN b ON a.k = b.k AND a.r = b.r GROUP BY 1
""")
def rank_assignment(t: Tables) -> DataFrame:
    """Balances of suppliers and customers of a nation by rank; what has no partner fails."""
    left = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("id"))
    right = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("id"))
    return assignment.repeatability(assignment.paired_by_rank(left, right, "nation", "v", "id"), "nation")


@query()
def assignment_repeatability(t: Tables) -> DataFrame:
    left = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("id"))
    right = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("id"))
    return assignment.min_cost_pairs(left, right, "nation", "v", "id")


@query("""
SELECT 'order_customer' AS "check", count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'line_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'event_customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
""")
def referential_integrity(t: Tables) -> DataFrame:
    checks = [
        (t.orders, t.customer, "o_custkey", "c_custkey", "order_customer"), (t.customer, t.nation, "c_nationkey", "n_nationkey", "customer_nation"), (t.lineitem, t.orders, "l_orderkey", "o_orderkey", "line_order"),
        (t.lineitem, t.part, "l_partkey", "p_partkey", "line_part"), (t.lineitem, t.supplier, "l_suppkey", "s_suppkey", "line_supplier"), (t.labels, t.documents, "doc_id", "doc_id", "label_document"), (t.events, t.customer, "user_id", "c_custkey", "event_customer"),
    ]
    out = None
    for check in checks:
        part = gates.orphans(*check)
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT id, side FROM (SELECT doc_id AS id, 'undeclared' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars > 800)
UNION ALL SELECT doc_id, 'missing' FROM (SELECT doc_id FROM documents WHERE n_chars > 800 EXCEPT SELECT doc_id FROM labels))
""")
def declared_and_found(t: Tables) -> DataFrame:
    out = gates.set_difference(t.documents.filter("n_chars > 800").select("doc_id"), t.labels.select("doc_id"), "doc_id")
    return out.select(F.col("doc_id").alias("id"), "side")


@query("""
WITH h AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 49),
w AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_regionkey = y.n_regionkey AS expected FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)
SELECT a, b, expected, h.a IS NOT NULL AS actual, expected = (h.a IS NOT NULL) AS correct FROM w LEFT JOIN h USING (a, b)
""")
def adjacency_truth(t: Tables) -> DataFrame:
    trade = t.lineitem.filter("l_quantity > 49").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = trade.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
    x, y = t.nation.alias("x"), t.nation.alias("y")
    truth = x.join(y, F.col("x.n_nationkey") < F.col("y.n_nationkey")).select(F.col("x.n_nationkey").alias("a"), F.col("y.n_nationkey").alias("b"), (F.col("x.n_regionkey") == F.col("y.n_regionkey")).alias("e"))
    return gates.pair_truth(pairs, truth, "a", "b", F.col("e"))


@query("""
SELECT l_orderkey, count(*) AS n, round(sqrt(sum(l_discount * l_discount)), 6) AS discount, round(sqrt(sum(l_discount * l_discount + l_tax * l_tax)), 6) AS total,
       round(CASE WHEN count(*) <= 1 THEN 0.15::double ELSE greatest(0.05::double, least(0.15::double, 0.15::double - avg(l_quantity) / 50 * (0.15::double - 0.05::double))) END, 6) AS uncertainty
FROM lineitem GROUP BY l_orderkey
""")
def quadrature(t: Tables) -> DataFrame:
    g = t.lineitem.withColumn("both", in_quadrature(F.col("l_discount"), F.col("l_tax"))).groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("l_discount") * F.col("l_discount"))).alias("discount"), F.sqrt(F.sum(F.col("both") * F.col("both"))).alias("total"), F.avg("l_quantity").alias("q"))
    return g.select("l_orderkey", "n", F.round("discount", 6).alias("discount"), F.round("total", 6).alias("total"), F.round(view_uncertainty(F.col("q") / 50, F.col("n")), 6).alias("uncertainty"))
