"""The jobs as queries: each is run twice into one new folder, and what then stands there is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import acceptance_report, notes_feed
from tesserae.session import shared_folder


def notes_feed_query(spark: SparkSession, folder: str) -> DataFrame:
    root, config = shared_folder(spark), notes_feed.settings()
    for _ in range(2):  # a pattern, for the table may be one file, which a file stream takes only so
        notes_feed.run(spark, f"{folder}/documents.parque[t]", f"{root}/out", f"{root}/checkpoint", config)
    report = notes_feed.read_report(spark, f"{root}/out").select(F.col("source").alias("s"), F.col("rule_id").alias("r"), F.col("notes").alias("source_notes"), F.col("flagged").alias("source_flagged"))
    flags = notes_feed.read_flags(spark, f"{root}/out")
    both = flags.join(report, F.col("source").eqNullSafe(F.col("s")) & F.col("rule_id").eqNullSafe(F.col("r")), "full")
    return both.select("doc_id", F.col("s").alias("source"), "lang", F.col("r").alias("rule_id"), "severity", "reasons", "source_notes", "source_flagged")


NOTES_SQL = r"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, len(regexp_extract_all(t, '[0-9A-Za-z.]+@[0-9A-Za-z.]+')) AS mails,
         (length(t) - length(replace(t, ' | ', ''))) // 3 AS cells, (length(t) - length(replace(t, '!!', ''))) // 2 AS marks,
         coalesce(100 * len(regexp_extract_all(t, '[A-Z]')) // nullif(len(regexp_extract_all(t, '[A-Za-z]')), 0), 0) AS upper_pct,
         (length(t) - length(replace(lower(t), 'licensed under', ''))) // 14 + (length(t) - length(replace(lower(t), 'general public license', ''))) // 22 + (length(t) - length(replace(lower(t), 'creative commons', ''))) // 16 AS licence,
         (length(t) - length(replace(lower(t), 'water stain', ''))) // 11 + (length(t) - length(replace(lower(t), 'mould', ''))) // 5 + (length(t) - length(replace(lower(t), 'damp patch', ''))) // 10 AS damp
  FROM t),
r AS (
  SELECT doc_id, source, lang, 'too_short' AS rule_id, 2 AS severity, 'n_words=' || n_words AS reasons FROM f WHERE n_words < 10
  UNION ALL SELECT doc_id, source, lang, 'contact_details', 4, 'mails=' || mails FROM f WHERE mails >= 1
  UNION ALL SELECT doc_id, source, lang, 'licence_text', 3, 'hits_licence=' || licence || ';n_words=' || n_words FROM f WHERE licence >= 1 AND n_words >= 10
  UNION ALL SELECT doc_id, source, lang, 'readings_table', 1, 'cells=' || cells FROM f WHERE cells >= 10
  UNION ALL SELECT doc_id, source, lang, 'urgent', 5, 'marks=' || marks || ';upper_pct=' || upper_pct FROM f WHERE marks >= 5 AND upper_pct >= 50 AND NOT cells >= 10
  UNION ALL SELECT doc_id, source, lang, 'damp_suspected', 4, 'hits_damp=' || damp FROM f WHERE damp >= 1),
n AS (SELECT source, count(*) AS source_notes FROM documents GROUP BY source),
c AS (SELECT source, rule_id, count(*) AS source_flagged FROM r GROUP BY source, rule_id)
SELECT r.doc_id, n.source, r.lang, r.rule_id, r.severity, r.reasons, n.source_notes, coalesce(c.source_flagged, 0) AS source_flagged
FROM n LEFT JOIN c ON n.source IS NOT DISTINCT FROM c.source LEFT JOIN r ON r.source IS NOT DISTINCT FROM n.source AND r.rule_id = c.rule_id
"""


def acceptance_report_query(spark: SparkSession, folder: str) -> DataFrame:
    root, config = shared_folder(spark), acceptance_report.settings()
    for _ in range(2):
        acceptance_report.run(spark, f"{folder}/lineitem.parquet", f"{folder}/part.parquet", root, config)
    matrix = acceptance_report.read_matrix(spark, root).select("gate", "tier", "n_scored", F.round("pass_rate", 6).alias("pass_rate"), F.round("worst", 6).alias("worst"))
    return acceptance_report.read_gates(spark, root).join(matrix, ["gate", "tier"], "full").select("month", "tier", "gate", "n", F.round("value", 6).alias("value"), "status", "n_scored", "pass_rate", "worst")


ACCEPTANCE_SQL = """
WITH lim(tier, a, r, f, h) AS (VALUES ('A', 1000::double, 0.4::double, 0.5::double, 0.6::double), ('N', 2000, 0.3, 0.4, 0.9), ('R', 500, 0.6, 0.4, 0.5), ('X', 1, 0.01, 0.95, 0.1)),
k AS (SELECT p_partkey, min(p_retailprice) AS price FROM part GROUP BY p_partkey),
x AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, tier, l_partkey, l_orderkey, l_extendedprice AS p, p_partkey IS NULL AS unknown, l_quantity * price AS t, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit, a, r, f, h
      FROM lineitem JOIN lim ON l_returnflag = tier LEFT JOIN k ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL),
j AS (SELECT month, tier, count(*) AS n, count(*) FILTER (NOT unknown) AS known, count(*) FILTER (abs(p - t) <= greatest(a, r * abs(t)) + 1e-9) AS ok,
             count(*) FILTER (t BETWEEN p - abs(p) * h - 1e-9 AND p + abs(p) * h + 1e-9) AS held, count(*) FILTER (unknown) AS bad FROM x GROUP BY month, tier),
s AS (SELECT month, tier, count(*) AS repeats, count(*) FILTER (hi - lo <= greatest(100, 0.5::double * greatest(abs(hi), abs(lo))) + 1e-9) AS agree
      FROM (SELECT month, tier, l_partkey, min(unit) AS lo, max(unit) AS hi FROM x WHERE unit IS NOT NULL GROUP BY month, tier, l_partkey HAVING count(*) > 1) GROUP BY month, tier),
u AS (SELECT * FROM (SELECT DISTINCT month FROM j) CROSS JOIN lim LEFT JOIN j USING (month, tier) LEFT JOIN s USING (month, tier)),
g AS (
  SELECT month, tier, 'accuracy' AS gate, coalesce(known, 0) AS n, CASE WHEN known > 0 THEN ok / known END AS value, f AS least_value FROM u
  UNION ALL SELECT month, tier, 'coverage', coalesce(known, 0), CASE WHEN known > 0 THEN held / known END, 0.4 FROM u
  UNION ALL SELECT month, tier, 'repeatability', coalesce(repeats, 0), CASE WHEN repeats > 0 THEN agree / repeats END, 0.3 FROM u
  UNION ALL SELECT month, tier, 'integrity', coalesce(n, 0), bad::double, NULL FROM u),
v AS (SELECT month, tier, gate, n, value, CASE WHEN n = 0 THEN 'SKIP' WHEN CASE WHEN gate = 'integrity' THEN value = 0 ELSE value >= least_value - 1e-9 END THEN 'PASS' ELSE 'FAIL' END AS status FROM g),
m AS (SELECT gate, tier, count(*) FILTER (n > 0) AS n_scored, avg((status = 'PASS')::int) FILTER (n > 0) AS pass_rate, CASE WHEN gate <> 'integrity' THEN min(value) FILTER (n > 0) ELSE max(value) FILTER (n > 0) END AS worst FROM v GROUP BY gate, tier)
SELECT month, tier, gate, n::bigint AS n, round(value, 6) AS value, status, n_scored, round(pass_rate, 6) AS pass_rate, round(worst, 6) AS worst FROM v JOIN m USING (gate, tier)
"""

QUERIES = {"job1_notes_feed": notes_feed_query, "job2_acceptance_report": acceptance_report_query}
ORACLES = {"job1_notes_feed": NOTES_SQL, "job2_acceptance_report": ACCEPTANCE_SQL}
