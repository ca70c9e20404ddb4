"""Rules, pricing, names, hashes and ids over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.geometry import equivalent_focal
from tesserae.operators import rules as ops
from tesserae.plans.registry import Tables, query

FIELDS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice", "p_type", "p_size"]
leaf = lambda f, op, v: {"field": f, "op": op, "value": v}
RULES = ops.checked_rules([
    {"id": "bulk", "text": "large orders", "when": {"all_of": [leaf("l_quantity", "gte", 45.0), leaf("l_discount", "gt", 0.05)]}},
    {"id": "returned", "text": "returned goods", "when": leaf("l_returnflag", "eq", "R")},
    {"id": "odd_size", "text": "very small or\n very large", "when": {"any_of": [leaf("p_size", "lt", 5), leaf("p_size", "gt", 45)]}},
    {"id": "plain", "text": "neither taxed nor discounted", "when": {"none_of": [leaf("l_tax", "gt", 0.0), leaf("l_discount", "gt", 0.0)]}},
    {"id": "types", "text": "chosen types", "when": {"all_of": [leaf("p_type", "in", ["ECONOMY", "PROMO"]), leaf("l_linestatus", "ne", "F")]}},
    {"id": "not_std", "text": "other types", "when": leaf("p_type", "not_in", ["STANDARD", "SMALL"])},
    {"id": "nested", "text": "nested", "when": {"all_of": [leaf("p_type", "contains", "O"), {"none_of": [leaf("l_quantity", "lte", 25.0)]}, {"any_of": [leaf("l_discount", "gte", 0.09), leaf("l_extendedprice", "lt", 5000.0)]}]}},
], FIELDS)

_LINES = """f AS (SELECT l.*, p_type, p_size FROM lineitem l LEFT JOIN part ON l_partkey = p_partkey AND p_size <> 13)"""
_CASES = {
    "bulk": "coalesce(l_quantity >= 45 AND l_discount > 0.05, false)",
    "returned": "coalesce(l_returnflag = 'R', false)",
    "odd_size": "coalesce(p_size < 5 OR p_size > 45, false)",
    "plain": "NOT (coalesce(l_tax > 0, false) OR coalesce(l_discount > 0, false))",
    "types": "coalesce(p_type IN ('ECONOMY', 'PROMO'), false) AND l_linestatus IS DISTINCT FROM 'F'",
    "not_std": "coalesce(p_type NOT IN ('STANDARD', 'SMALL'), true)",
    "nested": "coalesce(contains(p_type, 'O'), false) AND NOT coalesce(l_quantity <= 25, false) AND (coalesce(l_discount >= 0.09, false) OR coalesce(l_extendedprice < 5000, false))",
}


def _fired(t: Tables) -> DataFrame:
    parts = t.part.filter("p_size <> 13").select("p_partkey", "p_type", "p_size")
    return ops.firings(t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left"), RULES)


@query(f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM f WHERE {c} GROUP BY l_returnflag" for r, c in _CASES.items()))
def predicate_rules(t: Tables) -> DataFrame:
    return _fired(t).groupBy("rule_id", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"""
WITH {_LINES},
v AS (SELECT 'bulk' AS rule_id, unnest(['l_quantity', 'l_discount']) AS field, unnest([l_quantity, l_discount]) AS actual FROM f WHERE {_CASES["bulk"]}
      UNION ALL SELECT 'odd_size', 'p_size', p_size FROM f WHERE {_CASES["odd_size"]}
      UNION ALL SELECT 'nested', field, actual FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS field, unnest([l_quantity, l_discount, l_extendedprice]) AS actual,
            unnest([false, l_discount >= 0.09, l_extendedprice < 5000]) AS held FROM f WHERE {_CASES["nested"]}) WHERE held)
SELECT rule_id, field, count(*) AS n, count(DISTINCT actual) AS distinct_values, round(max(actual), 4) AS largest FROM v GROUP BY rule_id, field
""")
def rule_triggering_values(t: Tables) -> DataFrame:
    rows = _fired(t).filter(F.col("rule_id").isin("bulk", "odd_size", "nested")).select("rule_id", F.explode("values").alias("field", "actual")).filter("field <> 'p_type'")
    return rows.groupBy("rule_id", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("actual").cast("double")).alias("distinct_values"), F.round(F.max(F.col("actual").cast("double")), 4).alias("largest"))


CATALOGUE = [
    ("ECONOMY", 0, "paint", "area", 0.30, 0.10, 0.0), ("ECONOMY", 0, "visit", "count", 0.0, 0.0, 2.0), ("ECONOMY", 1, "board", "surface", 0.0, 0.15, 0.0), ("PROMO", 0, "tape", "extent", 0.15, 0.05, 4.0),
    ("PROMO", 1, "paint", "area", 0.10, 0.0, 9.0), ("STANDARD", 0, "board", "surface", 0.0, 0.0, 3.0), ("STANDARD", 1, "tape", "extent", 0.25, 0.0, 0.0), ("SMALL", 0, "visit", "count", 0.0, 0.0, 0.0), ("LARGE", 1, "paint", "area", 0.20, 0.12, 0.0),
]
_CATALOGUE_SQL = ", ".join(f"('{a}', {b}, '{c}', '{d}', {e}::double, {f}::double, {g}::double)" for a, b, c, d, e, f, g in CATALOGUE)


@query(f"""
WITH cat(k, s, code, basis, m, waste, least_q) AS (VALUES {_CATALOGUE_SQL}),
r AS (SELECT p_partkey, p_type AS k, p_partkey % 2 AS s, p_size / 10 AS w, p_retailprice / 1000 AS h, p_size / 10 * (p_retailprice / 1000) * 0.8::double AS area, CASE WHEN p_size > 25 THEN p_size / 5 END AS surf FROM part),
j AS (SELECT *, greatest(0, area - 0.1::double) AS alo, area + 0.1::double AS ahi, sqrt(w * w + h * h) AS e FROM r JOIN cat USING (k, s)),
b AS (SELECT *, CASE basis WHEN 'area' THEN (w + 2 * m) * (h + 2 * m) * (1 + waste) WHEN 'surface' THEN coalesce(surf, area) * (1 + waste) WHEN 'extent' THEN (e + 2 * m) * (1 + waste) ELSE 1 END AS q,
        CASE basis WHEN 'area' THEN (w * sqrt(alo / area) + 2 * m) * (h * sqrt(alo / area) + 2 * m) * (1 + waste) WHEN 'surface' THEN coalesce(surf, area) * (1 + waste) * 0.9::double WHEN 'extent' THEN greatest(0, e + 2 * m - 0.1::double) ELSE 1 END AS lo,
        CASE basis WHEN 'area' THEN (w * sqrt(ahi / area) + 2 * m) * (h * sqrt(ahi / area) + 2 * m) * (1 + waste) WHEN 'surface' THEN coalesce(surf, area) * (1 + waste) * 1.1::double WHEN 'extent' THEN e + 2 * m + 0.1::double ELSE 1 END AS hi FROM j),
x AS (SELECT *, q < least_q AS raised, greatest(q, least_q) AS quantity, CASE WHEN q < least_q THEN least_q ELSE lo END AS l2, CASE WHEN q < least_q THEN greatest(hi, least_q) ELSE hi END AS h2 FROM b)
SELECT p_partkey, code, basis, raised, round(quantity, 6) AS quantity, round(least(l2, h2, quantity), 6) AS ci_lo, round(greatest(l2, h2, quantity), 6) AS ci_hi FROM x
""")
def catalogue_pricing(t: Tables) -> DataFrame:
    catalogue = t.spark.createDataFrame(CATALOGUE, "k string, s int, code string, basis string, cut_back double, waste double, min_quantity double")
    w, h = F.col("p_size") / 10, F.col("p_retailprice") / 1000
    regions = t.part.select("p_partkey", F.col("p_type").alias("k"), (F.col("p_partkey") % 2).cast("int").alias("s"), w.alias("width"), h.alias("height"), (w * h * 0.8).alias("area"), F.when(F.col("p_size") > 25, F.col("p_size") / 5).alias("surface_area"))
    regions = regions.withColumn("area_lo", F.greatest(F.lit(0.0), F.col("area") - 0.1)).withColumn("area_hi", F.col("area") + 0.1).withColumn("extent", F.sqrt(F.col("width") ** 2 + F.col("height") ** 2))
    out = ops.priced(regions, F.broadcast(catalogue), ["k", "s"])
    return out.select("p_partkey", "code", "basis", "raised", *[F.round(c, 6).alias(c) for c in ("quantity", "ci_lo", "ci_hi")])


@query("""
WITH d AS (SELECT doc_id, source, doc_id // 256 AS b, doc_id // 65536 AS c, sha256(coalesce(text, '')) AS h FROM documents),
x AS (SELECT source, c, b, count(*) AS n, sha256(string_agg(doc_id::varchar || ':' || h, chr(10) ORDER BY doc_id, h)) AS h FROM d GROUP BY source, c, b),
y AS (SELECT source, c, sum(n) AS n, sha256(string_agg(b::varchar || ':' || h, chr(10) ORDER BY b)) AS h FROM x GROUP BY source, c)
SELECT source, sum(n)::bigint AS n, sha256(string_agg(c::varchar || ':' || h, chr(10) ORDER BY c)) AS digest FROM y GROUP BY source
""")
def content_hash(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return ops.tree_digest(rows, "source", "doc_id", "h")


PROMPTS = ["red", "small ring", "blue gear", "steel bolt", "green", "large brass", "valve"]


@query("""
WITH p(pos, p) AS (VALUES (0, 'red'), (1, 'small ring'), (2, 'blue gear'), (3, 'steel bolt'), (4, 'green'), (5, 'large brass'), (6, 'valve')),
n AS (SELECT DISTINCT lower(trim(p_name)) AS name FROM part),
m AS (SELECT name, p, CASE WHEN name = p THEN 0 WHEN contains(name, p) OR (name <> '' AND contains(p, name)) THEN 1 WHEN list_has_any(string_split(name, ' '), string_split(p, ' ')) THEN 2 END AS how,
      row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = p THEN 0 WHEN contains(name, p) OR (name <> '' AND contains(p, name)) THEN 1 WHEN list_has_any(string_split(name, ' '), string_split(p, ' ')) THEN 2 ELSE 3 END, length(p) DESC, pos) AS r FROM n, p)
SELECT p_name, count(*) AS n, any_value(CASE WHEN how IS NOT NULL THEN p END) AS prompt FROM part JOIN m ON lower(trim(p_name)) = name AND r = 1 GROUP BY p_name
""")
def prompt_match(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).withColumn("prompt", ops.best_prompt(F.col("p_name"), PROMPTS))


@query("""
SELECT event_id, round(coalesce(f / 36.0::double * 4032, 4032 / (2 * tan(radians(65.0::double) / 2))), 6) AS focal_px, f IS NOT NULL AS from_exif
FROM (SELECT event_id, CASE WHEN (props->>'$.k')::int > 20 THEN (props->>'$.k')::int END AS f FROM events)
""")
def exif_focal(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select("event_id", F.when(k > 20, k).alias("f"))
    return rows.select("event_id", F.round(equivalent_focal(F.col("f"), F.lit(4032)), 6).alias("focal_px"), F.col("f").isNotNull().alias("from_exif"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || '_w' || (row_number() OVER w - 1) AS id, l_orderkey || '_op' || lpad((row_number() OVER w)::varchar, 2, '0') AS padded,
       (row_number() OVER w - 1)::bigint AS parsed
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
""")
def ids_enumerate(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = t.lineitem.withColumn("n", place)
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.format_string("%d_w%d", F.col("l_orderkey"), F.col("n") - 1).alias("id"), F.format_string("%d_op%02d", "l_orderkey", "n").alias("padded"))
    return rows.withColumn("parsed", F.regexp_extract("id", r"_w(\d+)$", 1).cast("long"))


@query("""
SELECT o_orderpriority, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def strongest_per_kind(t: Tables) -> DataFrame:
    """The row of the largest score of each kind, the first of equals: one aggregation."""
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(best.alias("b")).select("o_orderpriority", "o_orderstatus", "b.*")


@query("""
WITH d AS (SELECT lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r, doc_id FROM documents)
SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM d WHERE r <= 5
""")
def top_k_in_order(t: Tables) -> DataFrame:
    """The five largest of each group, then in their original order."""
    top = t.documents.select("lang", "doc_id", "n_chars").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).filter("r <= 5")
    return top.select("lang", "doc_id", "n_chars", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).cast("long").alias("position"))


@query("""
SELECT conv_id, count(*) AS turns, to_json({'turns': list({'turn': turn, 'role': role} ORDER BY turn, role)})::varchar AS doc FROM conversations GROUP BY conv_id
""")
def nested_documents(t: Tables) -> DataFrame:
    """Rows assembled into one nested JSON document for each key."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.to_json(F.struct(turns.alias("turns"))).alias("doc"))


@query("""
SELECT doc_id, trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g')) AS title, upper(substr(source, 1, 1)) || substr(source, 2) AS origin,
       contains(coalesce(text, ''), 'License') AND NOT contains(coalesce(text, ''), 'MIT') AS licensed, printf('%06d', doc_id) AS padded FROM documents
""".replace("\\\\", "\\"))
def text_clean_up(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    title = F.trim(F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"[ \t\r\n\f\x0B]+", " "))
    return t.documents.select("doc_id", title.alias("title"), F.initcap("source").alias("origin"), (F.contains(text, F.lit("License")) & ~F.contains(text, F.lit("MIT"))).alias("licensed"), F.format_string("%06d", "doc_id").alias("padded"))
