"""Quality rules at the level of hosts.

Document rules give counts and failures for each text. Failures are summed by host and rule,
the rates are shrunk towards the corpus rate with a beta prior fitted by moments, and the
verdicts on hosts go back to their documents. All of it is DataFrame expressions.

Defined cases: a null or empty text has no words, so it fails the base rule; a null host is a
host of its own; repeated rows each count; an empty table gives an empty result; an input
column with the name of an output gives way to it; texts of any length are counted whole. Repeated
windows are told by 64-bit hashes of their words' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, quoted, with_outputs, words_of

#: A host is rejected when a shrunk rate of one rule is above REJECT. On a host with a shrunk
#: rate above WATCH, the documents that fail that rule themselves are rejected.
REJECT, WATCH = 0.5, 0.02
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("base_failed", "symbol_heavy", "dup_heavy")


def repeated_words(words: Column, n: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    Window keys are sorted with their positions; those with an equal neighbour repeat. The
    union of the repeated windows is the sum of their gaps, each capped at the window's length.
    """
    keys = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(keys, lambda k: F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.struct(F.xxhash64(*[F.get(k, i + j) for j in range(-1, window - 1)]).alias("k"), i.alias("i"))))

    def starts(s: Column) -> Column:
        repeat = F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) & (i > 0) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
        return F.sort_array(F.transform(repeat, lambda x: x["i"]))

    def union(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(F.sort_array(windows), lambda s: let(starts(s), union))
    return F.when(n >= window + 1, found).otherwise(F.lit(0).cast("long"))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the columns of COUNTS."""
    value = F.coalesce(quoted(text), F.lit(""))
    words = "__tsr_words"
    wide = docs.withColumn(words, words_of(quoted(text)))
    n = F.size(words)
    lines = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return with_outputs(wide, {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(value, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words), n),
    }).drop(words)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user, port, a last dot and a leading "www."; null
    where there is none."""
    place = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.lower(place), r"\.$", ""), r"^www\.(?=[^.]+\.)", "")
    return F.when(bare != "", bare)


def rule_failures() -> dict[str, Column]:
    """The document rules. None is null, so no null check of theirs is pushed to the scan."""
    c = F.col
    rules = {
        "base_failed": (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")),
        "symbol_heavy": 10 * c("n_symbols") > c("word_chars"),
        "dup_heavy": 2 * c("n_dup_lines") > c("n_lines"),
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def host_verdicts(failures: DataFrame, host: str, reject: float = REJECT, watch: float = WATCH) -> DataFrame:
    """host, n, and for each rule fails, the shrunk rate, rejected and watched.

    The prior of a rule has mean m = fails / documents and strength m(1-m)/v - 1, held in
    [1, 1e6], where v is the variance of host rates beyond that of the binomial.
    """
    hosts = failures.groupBy(quoted(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"{r}_fails") for r in RULES])
    total = hosts.agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__hosts"), *[F.sum(f"{r}_fails").alias(f"__{r}_f") for r in RULES],
                      *[F.sum(F.col(f"{r}_fails") / F.col("n") * F.col(f"{r}_fails")).alias(f"__{r}_q") for r in RULES])
    out = hosts.crossJoin(total)  # one row
    for r in RULES:
        m = F.col(f"__{r}_f") / F.col("__n")
        spread = F.col(f"__{r}_q") / F.col("__n") - m * m
        beyond = F.greatest(spread - m * (1 - m) * F.col("__hosts") / F.col("__n"), F.lit(1e-12))
        strength = F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / beyond - 1))
        out = out.withColumn(f"{r}_rate", (F.col(f"{r}_fails") + m * strength) / (F.col("n") + strength))
    rates = [F.col(f"{r}_rate") for r in RULES]
    return out.select("host", "n", *[f"{r}_fails" for r in RULES], *[f"{r}_rate" for r in RULES],
                      F.greatest(*rates) > reject, *[x > watch for x in rates]).toDF(
        "host", "n", *[f"{r}_fails" for r in RULES], *[f"{r}_rate" for r in RULES], "rejected", *[f"{r}_watched" for r in RULES])


def host_rules(docs: DataFrame, *, text: str = "text", host: str = "source", reject: float = REJECT, watch: float = WATCH, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with COUNTS, RULES and kept.

    Counts are made once and written to the shared folder with the columns that stay; hosts and
    documents are judged from that table. The verdicts are a table of one row for each host, written to the shared folder. Spark
    broadcasts it only if its measured size is below the session's threshold; beyond that it
    is a shuffled join whose hot hosts adaptive execution splits.
    """
    scratch = Scratch(docs.sparkSession)
    judged = with_outputs(text_counts(docs.withColumn("__tsr_host", quoted(host)), text), rule_failures())
    stay = [c for c in docs.columns if keep is None or c in keep]
    made = {c.lower() for c in (*COUNTS, *RULES)}
    judged = scratch.keep(judged.select(*[quoted(c) for c in stay if c.lower() not in made], *COUNTS, *RULES, "__tsr_host"), "judged")
    narrow = judged.select("__tsr_host", *RULES)
    verdicts = scratch.keep(host_verdicts(narrow, "__tsr_host", reject, watch), "hosts")
    verdicts = verdicts.select(F.col("host").alias("__tsr_h"), F.col("rejected").alias("__tsr_rejected"), *[F.col(f"{r}_watched").alias(f"__tsr_{r}") for r in RULES])
    joined = judged.join(verdicts, F.col("__tsr_host").eqNullSafe(F.col("__tsr_h")), "left")
    against = F.col("base_failed").cast("int") + F.coalesce(F.col("__tsr_rejected"), F.lit(False)).cast("int")
    for r in RULES:
        against = against + (F.col(r) & F.coalesce(F.col(f"__tsr_{r}"), F.lit(False))).cast("int")
    kept = against == 0
    return with_outputs(joined, {"kept": kept}).drop("__tsr_h", "__tsr_host", "__tsr_rejected", *[f"__tsr_{r}" for r in RULES])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
u AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN u USING (rid)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > word_chars AS symbol_heavy, 2 * n_dup_lines > n_lines AS dup_heavy
  FROM m),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3]) AS rule, unnest([sum(base_failed::int), sum(symbol_heavy::int), sum(dup_heavy::int)])::double AS x FROM f GROUP BY source),
p AS (SELECT rule, sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) AS q, count(*) AS hosts, sum(n) AS docs FROM h GROUP BY rule),
s AS (SELECT rule, m, greatest(1.0, least(1e6, m * (1 - m) / greatest(q - m * m - m * (1 - m) * hosts / docs, 1e-12) - 1)) AS s FROM p),
v AS (SELECT source, rule, (x + m * s) / (n + s) AS rate FROM h JOIN s USING (rule)),
b AS (SELECT source, max(rate) > 0.5 AS rejected, max(rate) FILTER (rule = 1) > 0.02 AS w1, max(rate) FILTER (rule = 2) > 0.02 AS w2, max(rate) FILTER (rule = 3) > 0.02 AS w3 FROM v GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AND NOT (symbol_heavy AND w2) AND NOT (dup_heavy AND w3) AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return host_rules(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
