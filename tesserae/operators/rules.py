"""Rule firing and catalogue pricing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.predicates import compiled, triggering_values, validated


def checked_rules(rules: list[dict], fields: list[str]) -> list[dict]:
    """Rules with a unique id, a text and a valid predicate; white space of the text is folded."""
    if not rules:
        raise ValueError("no rules")
    ids = [r.get("id") for r in rules]
    if len(set(ids)) < len(ids) or not all(ids):
        raise ValueError("every rule needs an id of its own")
    out = []
    for r in rules:
        if not str(r.get("text") or "").strip():
            raise ValueError(f"rule {r['id']} has no text")
        out.append(r | {"when": validated(r["when"], fields), "text": " ".join(str(r["text"]).split())})
    return out


def firings(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """One row for each row and rule that fires: rule_id, rule_pos, values. One scan whatever the
    number of rules; the predicates are part of one expression."""
    each = [F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(i).alias("rule_pos"), F.when(compiled(r["when"]), triggering_values(r["when"])).alias("values")) for i, r in enumerate(rules)]
    fired = F.filter(F.array(*each), lambda r: r["values"].isNotNull())
    return rows.withColumn("__fired", F.explode(fired)).select("*", "__fired.*").drop("__fired")


def _side(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a)


def priced(regions: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """One line for each region and catalogue row of its keys; a region without one has no line.

    regions: width, height, area, area_lo, area_hi, extent, surface_area (may be null).
    catalogue: basis (area, surface, extent, count), cut_back, waste, min_quantity.
    Adds quantity, ci_lo, ci_hi and raised (to the minimum charge)."""
    r = regions.join(catalogue, keys)
    c = F.col
    w, h, m, more = c("width"), c("height"), c("cut_back"), 1.0 + c("waste")
    grown = lambda w, h: _side(w + 2 * m) * _side(h + 2 * m)
    scale = lambda a: F.when(c("area") > 0, F.sqrt(_side(a) / c("area"))).otherwise(1.0)
    surface = F.coalesce("surface_area", "area") * more
    long = c("extent") + 2 * m
    pick = lambda area, surf, ext, count: F.when(c("basis") == "area", area).when(c("basis") == "surface", surf).when(c("basis") == "extent", ext).otherwise(count)
    lo, hi = scale(c("area_lo")), scale(c("area_hi"))
    r = r.withColumn("__q", pick(grown(w, h) * more, surface, long * more, F.lit(1.0)))
    r = r.withColumn("__lo", pick(grown(w * lo, h * lo) * more, surface * 0.9, _side(long - 0.1), F.lit(1.0)))
    r = r.withColumn("__hi", pick(grown(w * hi, h * hi) * more, surface * 1.1, long + 0.1, F.lit(1.0)))
    raised = c("__q") < c("min_quantity")
    quantity = F.when(raised, c("min_quantity")).otherwise(c("__q"))
    r = r.withColumn("raised", raised).withColumn("quantity", quantity)
    r = r.withColumn("__lo", F.when(c("raised"), c("min_quantity")).otherwise(c("__lo"))).withColumn("__hi", F.when(c("raised"), F.greatest("__hi", "min_quantity")).otherwise(c("__hi")))
    # the interval brackets the quantity
    r = r.withColumn("ci_lo", F.least("__lo", "__hi", "quantity")).withColumn("ci_hi", F.greatest("__lo", "__hi", "quantity"))
    return r.drop("__q", "__lo", "__hi")


def explained() -> Column:
    """The arithmetic of a priced line in words."""
    area = F.format_string("patch %.2f x %.2f m, cut back %.2f m each side", "width", "height", "cut_back")
    surface = F.format_string("whole surface %.2f m2", F.coalesce("surface_area", "area"))
    extent = F.format_string("extent %.2f m plus %.2f m each end", "extent", "cut_back")
    text = F.when(F.col("basis") == "area", area).when(F.col("basis") == "surface", surface).when(F.col("basis") == "extent", extent).otherwise("one occurrence")
    return F.concat(text, F.when(F.col("raised"), F.format_string("; raised to the minimum of %.2f", "min_quantity")).otherwise(""))


def best_prompt(name: Column, prompts: list[str]) -> Column:
    """The prompt equal to a name, else the longest that holds it or is held by it, else the
    longest that shares a word; the first of equals; null for none."""
    ranked = sorted(enumerate(prompts), key=lambda p: (-len(p[1]), p[0]))
    lowered = F.lower(F.trim(name))
    out = F.when(lowered.isin(prompts), lowered)
    for _, p in ranked:
        out = out.when(F.contains(lowered, F.lit(p)) | ((lowered != "") & F.contains(F.lit(p), lowered)), F.lit(p))
    for _, p in ranked:
        out = out.when(F.arrays_overlap(F.split(lowered, " "), F.array(*[F.lit(w) for w in p.split()])), F.lit(p))
    return out


def tree_digest(rows: DataFrame, group: str, key: str, digest: str, fan: int = 256) -> DataFrame:
    """(group, n, digest) of rows with integer keys and hexadecimal digests: SHA-256 over the
    ordered "key:digest" lines of blocks of `fan` keys, over those of blocks of fan^2 keys, and
    over these. No step gathers more than one block; it is not the digest of one long list."""
    level = rows.select(group, F.col(key).alias("k"), F.col(digest).alias("h"), F.lit(1).cast("long").alias("n"))
    for by in ("k div {0}", "k div {0}", None):
        lines = F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["h"]))
        keys = [group] if by is None else [group, F.expr(by.format(fan)).alias("b")]
        level = level.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("h"))
        if by is not None:
            level = level.withColumnRenamed("b", "k")
    return level.select(group, "n", F.col("h").alias("digest"))
