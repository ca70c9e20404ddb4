"""Runs of words that repeat with a period, found in two steps.

1. Masking. A run of period q and length L has L - q words that equal the word q later, so with
   L >= max(least, times * q) some k = min over q of (max(least, times * q) - q) consecutive ones
   always do: every word of a run lies in a k-gram that occurs twice in its document. Words
   outside such k-grams cannot join a run. Grams are compared by 64-bit hashes; an accidental match
   only lets words survive that the second step then judges exactly.
2. Main-Lorentz on the stretches of surviving words. A stretch is halved again and again; a run
   crosses the middle of the largest block whose middle it crosses, and lies whole in that block. For
   each period the words beside the middle are compared, and where they agree, the run is extended both
   ways by longest common extensions over ranks of doubled length. All blocks of a level, of all
   stretches of a batch of documents, are looked at in the same array operations.

Of runs with the same extent the one of the least period stays. A word is dropped where some run
contains it after the run's first period.

Defined cases: a null or empty text has no words, no runs and '' left; words are compared byte by byte; equal
rows give equal results, each its own row; ties need no rule (extent and period tell runs apart); an empty
table gives an empty result; only the key and columns in keep stay, and one named like an output gives
way. A text of any length is looked at whole, in one task, where it needs about 4 bytes times the
logarithm of its surviving words for each of those words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, pieces, quoted, small_batches, words_of

LEAST, TIMES = 6, 4
PIECE = 1 << 20  # bytes of text looked at together
_MIX = np.uint64(0x9E3779B97F4A7C15)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def gram_size(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words in a row that equal the word one period later, over all runs."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): starts[i], starts[i] + 1, ... sizes[i] values for each i."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    first = np.cumsum(sizes) - sizes
    return owner, np.arange(owner.size) - first[owner] + starts[owner]


def surviving(ids: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the stretches of words inside k-grams that occur twice in their document."""
    none = np.zeros(0, np.int64)
    if ids.size <= k:
        return none, none
    with np.errstate(over="ignore"):
        grams = doc[: ids.size - k + 1].astype(np.uint64) * _MIX
        for j in range(k):
            grams = (grams ^ (grams >> np.uint64(29))) * _MIX + ids[j : ids.size - k + 1 + j].astype(np.uint64)
        grams *= _MIX
    whole = np.flatnonzero(doc[: ids.size - k + 1] == doc[k - 1 :])
    order = whole[np.argsort(grams[whole])]
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(order.size, bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(ids.size + 1, np.int64)
    np.add.at(step, order[twice], 1)
    np.add.at(step, order[twice] + k, -1)
    inside = np.cumsum(step[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def doubled_ranks(w: np.ndarray) -> list[np.ndarray]:
    """ranks[j][i] names w[i : i + 2**j]; equal names, equal words. Ends when no stretch occurs twice.
    Stretches past the end have names of their own."""
    ranks = [np.unique(w, return_inverse=True)[1].astype(np.int32)]
    while 1 << len(ranks) < w.size:
        last, half = ranks[-1], 1 << (len(ranks) - 1)
        pair = last[:-half].astype(np.int64) << 32 | last[half:]
        names, inverse = np.unique(pair, return_inverse=True)
        if names.size == pair.size:
            break
        tail = np.arange(names.size, names.size + half, dtype=np.int32)
        ranks.append(np.concatenate([inverse.astype(np.int32), tail]))
    return ranks


def common_after(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    n, got = ranks[0].size, np.zeros(i.size, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        at = j + got
        fits = np.flatnonzero(at + (1 << level) <= n)
        same = fits[ranks[level][i[fits] + got[fits]] == ranks[level][at[fits]]]
        got[same] += 1 << level
    return got


def common_before(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words up to i equal those up to j (i < j, both included)."""
    got = np.zeros(i.size, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        at = i - got - (1 << level) + 1
        fits = np.flatnonzero(at >= 0)
        same = fits[ranks[level][at[fits]] == ranks[level][at[fits] + (j - i)[fits]]]
        got[same] += 1 << level
    return got


def main_lorentz(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, stop, period) of all runs inside the blocks [lo, hi) of w, by start and period.
    Outside and between blocks w must hold values that occur once."""
    found = []
    ranks: list[np.ndarray] = []
    lo, hi = np.asarray(lo, np.int64), np.asarray(hi, np.int64)
    while (big := hi - lo >= max(least, times)).any():
        lo, hi = lo[big], hi[big]
        mid = (lo + hi) // 2
        block, p = _spread(np.ones(lo.size, np.int64), (hi - lo) // times)
        m = mid[block]
        for shift in (0, 1):  # the period after the middle lies in the run, or the one before it does
            a, b = (m - 1, m - 1 + p) if shift == 0 else (m - p, m)
            ok = np.flatnonzero((a >= lo[block]) & (b < hi[block]))
            ok = ok[w[a[ok]] == w[b[ok]]]
            if not ok.size:
                continue
            ranks = ranks or doubled_ranks(w)
            a, b, period = a[ok], b[ok], p[ok]
            start, stop = a - common_before(ranks, a, b) + 1, b + common_after(ranks, a, b)
            keep = stop - start >= np.maximum(least, times * period)
            found.append(np.stack([start[keep], stop[keep], period[keep]], axis=1))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, stop, period), places in ids, of the runs of all documents; doc is the number of
    each word's document, in order."""
    start, stop = surviving(ids, doc, gram_size(least, times))
    if not start.size:
        return np.zeros((0, 3), np.int64)
    size = stop - start
    lo = np.cumsum(size + 1) - (size + 1)  # one word that occurs nowhere else after each stretch
    _, at = _spread(start, size)
    _, to = _spread(lo, size)
    w = -1 - np.arange(int(size.sum()) + size.size, dtype=np.int64)
    w[to] = ids[at]
    runs = main_lorentz(w, lo, lo + size, least, times)
    shift = (start - lo)[np.searchsorted(lo, runs[:, 0], side="right") - 1]
    return runs + np.stack([shift, shift, np.zeros_like(shift)], axis=1)


def _piece(texts: list[str | None], least: int, times: int) -> tuple[list[int], list[list[tuple[int, int, int]]], list[str]]:
    words = [(t or "").encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(x) for x in words], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(x, len(known)) for ws in words for x in ws), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(sizes.size), sizes)
    runs = runs_of(ids, doc, least, times)
    step = np.zeros(ids.size + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    dropped = np.cumsum(step[:-1]) > 0
    listed: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, (start, stop, period) in zip(doc[runs[:, 0]].tolist(), runs.tolist()):
        listed[d].append((start - int(first[d]), stop - start, period))
    left = []
    for d, ws in enumerate(words):
        if listed[d]:
            ws = [ws[i] for i in np.flatnonzero(~dropped[first[d] : first[d] + sizes[d]])]
        left.append(b" ".join(ws).decode("utf-8", "replace"))
    return sizes.tolist(), listed, left


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, keep: list[str] | None = None) -> DataFrame:
    """Per row: key, the columns in keep, n_words, runs (start, length, period; by start, then period) and
    collapsed (the words left, joined by one space)."""
    if times < 2 or least < 2:
        raise ValueError("times and least must be 2 or more")
    small_batches(docs.sparkSession)
    outputs = {"n_words", "runs", "collapsed"}
    stay = [key, *[c for c in keep or [] if c != key and c.lower() not in outputs]]
    rows = docs.select(*[quoted(c) for c in stay], quoted(text).cast("string").alias("__tsr_text"))
    made = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("collapsed", T.StringType())]
    schema = T.StructType([*[rows.schema[c] for c in stay], *[T.StructField(n, t) for n, t in made]])
    arrow_runs = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.fieldNames()]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__tsr_text", PIECE):
                n, runs, left = _piece(part.column(len(stay)).to_pylist(), least, times)
                runs = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(stay)], pa.array(n, pa.int64()), pa.array(runs, arrow_runs), pa.array(left, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(look, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equals the first. Null for no run."""
    better = lambda acc, r: acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda acc, r: F.when(better(acc, r), r).otherwise(acc))


def with_planted_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's input: where h = crc32(key as text) ends in 0, the words from a on repeat with period p."""
    h = F.crc32(F.coalesce(quoted(key).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def tailed(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    planted = F.when(h % 10 == 0, let(words_of(quoted(text)), lambda w: F.when(F.size(w) > 0, tailed(w)).otherwise(F.lit(""))))
    return docs.select(quoted(key), planted.otherwise(quoted(text)).alias(text))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
           lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i::BIGINT, 1))::BIGINT], list_transform(range(8), lambda b: (-1)::BIGINT))))),
           lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END) AS c
  FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, xor(c, 4294967295) % 10 = 0 AND len(w) > 0 AS tail, xor(c, 4294967295) // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN tail THEN g % n END AS a FROM h),
p AS (SELECT *, CASE WHEN tail THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN tail THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
x AS MATERIALIZED (SELECT rid, n, i, w[i + 1] AS w, hash(w[i + 1:i + 5]) AS k FROM (SELECT rid, n, w, unnest(range(n)) AS i FROM t)),
m AS (SELECT rid, q, unnest(range(0, n - q, q)) AS i FROM (SELECT rid, n, unnest(range(1, n // 4 + 1)) AS q FROM t WHERE n >= 6)),
c AS MATERIALIZED (SELECT DISTINCT m.rid, m.q FROM m JOIN x y ON y.rid = m.rid AND y.i = m.i JOIN x z ON z.rid = m.rid AND z.i = m.i + m.q WHERE y.k = z.k),
e AS (SELECT c.rid, c.q, y.i, y.i - row_number() OVER (PARTITION BY c.rid, c.q ORDER BY y.i) AS island FROM c JOIN x y ON y.rid = c.rid JOIN x z ON z.rid = c.rid AND z.i = y.i + c.q WHERE y.w = z.w),
r AS (SELECT rid, start, length, min(q) AS period FROM (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY rid, q, island) WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length),
b AS (
  SELECT rid, count(*) AS n_runs, first(start ORDER BY length / period DESC, start, period) AS start, first(length ORDER BY length / period DESC, start, period) AS length,
         first(period ORDER BY length / period DESC, start, period) AS period, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY rid),
g AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
l AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS left_over FROM x ANTI JOIN g USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(with_planted_tails(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
