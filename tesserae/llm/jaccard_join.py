"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles. Equal sets are one node with copies. Candidates share a band of
MinHash values; inside a bucket, signatures are compared a few values at a time and a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold falls
below a tolerance. What survives only joins nodes into groups; inside each group every pair is
verified exactly on the shingle sets and its links are counted.

No step emits the pairs of a bucket or group: buckets yield a spanning forest of survivors, and
groups a count for each node. Buckets and groups of more than a block of members are dealt as
pairs of blocks, so a task holds two blocks however many copies there are.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z made lower case; a text of fewer words than
a shingle is one shingle. Recall: a pair at the threshold 0.8 shares none of the 32 bands of 5
with probability 3e-6 and is pruned with probability about 1e-5.

Defined cases: null, empty and blank texts have no shingles, link to nothing and are classes of
their own; null keys rank below none (a class takes its least non-null key; it has a null id if
all keys are null); rows that repeat a key have each the class of their own text; an empty table
gives an empty result; texts of any length are hashed whole; columns other than key and text do not matter, but for which of the rows of
one key and text stands for its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import graph
from tesserae.session import Steps

from .common import Scratch, pieces, quoted, stream_groups

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Posterior below which a pair is dropped, and after how many values each look comes.
TOLERANCE, LOOKS = 1e-6, (32, 64, 96, 128, HASHES)
#: Members of a block of a bucket (signatures) and of a group (shingle sets).
BUCKET_BLOCK, GROUP_BLOCK = 512, 512

_rng = np.random.default_rng(20240101)
MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- shingles and signatures ---------------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], hashes: dict, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, flat; and where each text starts."""
    if len(hashes) > 200_000:
        hashes.clear()
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        own = (text or "").encode("utf-8", "replace").lower().split()
        counts[i] = len(own)
        words += own
    flat = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    begins = np.cumsum(counts) - counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), made)
    at = begins[owner] + np.arange(owner.size) - (np.cumsum(made) - made)[owner]
    sums = np.zeros(owner.size, dtype=np.uint64)
    full = counts[owner] >= size
    for j in range(size):
        inside = full | (j < counts[owner])
        sums[inside] += flat[at[inside] + j] * POWERS[j]
    sums = mixed(sums + np.uint64(size))
    order = np.lexsort((sums, owner))
    sums, owner = sums[order], owner[order]
    new = np.ones(sums.size, dtype=bool)
    new[1:] = (sums[1:] != sums[:-1]) | (owner[1:] != owner[:-1])
    sums, owner = sums[new], owner[new]
    return sums, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of HASHES values for each text that has shingles."""
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    out = np.empty((starts.size, HASHES), dtype=np.uint32)
    product = np.empty_like(sets)
    for i in range(HASHES if starts.size else 0):
        np.multiply(sets, MULTIPLIERS[i], out=product)
        out[:, i] = np.minimum.reduceat(product, starts) >> np.uint64(32)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            flat, at = shingle_sets(part.column(2).to_pylist(), hashes)
            size = np.diff(at)
            rows = iter(signatures(flat, at))
            signed = [next(rows).tobytes() if n else None for n in size.tolist()]
            digest = np.array([xxhash.xxh64_intdigest(flat[a:b].tobytes()) for a, b in zip(at, at[1:])], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(digest), pa.array(size), pa.array(signed, pa.binary())], names=["key", "h", "r", "node", "size", "sig"])


# --- pruning -------------------------------------------------------------------------------


def posterior(matches: int, looks: int, threshold: float) -> float:
    """P(similarity >= threshold) after so many equal values, with a uniform prior."""
    grid = (np.arange(4000) + 0.5) / 4000
    log = matches * np.log(grid) + (looks - matches) * np.log1p(-grid)
    weight = np.exp(log - log.max())
    return float(weight[grid >= threshold].sum() / weight.sum())


def needed(threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(from, to, least matches) of each look."""
    out, start = [], 0
    for stop in LOOKS:
        low, high = 0, stop
        while low < high:  # the posterior rises with the matches
            mid = (low + high) // 2
            low, high = (mid + 1, high) if posterior(mid, stop, threshold) < tolerance else (low, mid)
        out.append((start, stop, low))
        start = stop
    return out


def survivors(one: np.ndarray, many: np.ndarray, plan: list[tuple[int, int, int]]) -> np.ndarray:
    """Which rows of many are not pruned against one."""
    alive, count = np.arange(len(many)), np.zeros(len(many), dtype=np.int64)
    for start, stop, least in plan:
        rows = many[alive, start:stop] if alive.size < len(many) else many[:, start:stop]
        count = count + (rows == one[start:stop]).sum(axis=1)
        stay = count >= least
        alive, count = alive[stay], count[stay]
        if not alive.size:
            break
    return alive


def forest(sigs: np.ndarray, plan) -> np.ndarray:
    """Root of each row in the graph of survivors: breadth first, each row against those left."""
    root = np.full(len(sigs), -1)
    left = np.arange(len(sigs))
    while left.size:
        seed, left = left[0], left[1:]
        root[seed], frontier = seed, [seed]
        while frontier and left.size:
            found = survivors(sigs[frontier.pop()], sigs[left], plan)
            root[left[found]] = seed
            frontier += left[found].tolist()
            left = np.delete(left, found)
    return root


def _bucket_edges(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        held = 0
        for _, table in stream_groups(batches, ["bucket", "i", "j"]):
            node = table.column("node").to_numpy()
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(len(node), HASHES)
            order = np.argsort(node)  # the least node of a tree is its root
            node, root = node[order], forest(sigs[order], plan)
            joined = root != np.arange(len(node))
            if joined.any():
                out_a.append(node[joined])
                out_b.append(node[root[joined]])
                held += int(joined.sum())
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
                out_a, out_b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return run


# --- groups --------------------------------------------------------------------------------


def in_blocks(rows: DataFrame, member: str, size: str, block: int) -> DataFrame:
    """rows with i, j: each row once for each pair of blocks that its own block is part of."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(7)), blocks).cast("int")
    spread = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b), as a table of its own.
    Rounds grow with the logarithm of the nodes (operators.graph)."""
    steps = Steps(edges.sparkSession)
    edges = scratch.keep(edges, f"{name}-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = graph.components(nodes, edges, steps).select("node", F.col("component").alias("label"))
    labels = scratch.keep(labels, name)
    steps.drop()
    scratch.drop(f"{name}-edges")
    return labels


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts' shingles, once for each node of a task: rows equal in key and text come side by
    side out of the sorted join, and only the first of them goes on."""
    last = None
    hashes = _Hashes()
    for batch in batches:
        node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
        if not len(node):
            continue
        new = np.sort(np.unique(node, return_index=True)[1])
        new = new[node[new] != last] if last is not None else new
        last = node[-1]
        for part in pieces(batch.take(pa.array(new)), "text", 1 << 20):
            flat, at = shingle_sets(part.column(part.schema.get_field_index("text")).to_pylist(), hashes)
            sets = pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in ("node", "label", "members")], sets], names=["node", "label", "members", "sets"])


def links_of(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose exact similarity reaches the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=values.size) > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    width = max(256, (4 << 20) // max(n, 1))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        dense = np.zeros((n, width), dtype=np.float32)
        dense[row[a:b], column[a:b] - at] = 1.0
        common += dense @ dense.T
    union = size[:, None] + size[None, :] - common
    out = common >= threshold * union - 1e-9
    np.fill_diagonal(out, False)
    return out


def _group_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links, roots, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], names=["node", "links", "root"])

        for (_, i, j), table in stream_groups(batches, ["label", "i", "j"]):
            node, first = np.unique(table.column("node").to_numpy(), return_index=True)  # repeated rows
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("sets").take(pa.array(first)).to_pylist()]
            linked = links_of(sets, threshold)
            if i != j:  # pairs inside a block belong to the block's own task
                mine = table.column("mine").to_numpy()[first]
                linked &= mine[:, None] != mine[None, :]
            root = np.full(len(node), -1)
            for k in range(len(node)):
                if root[k] < 0:
                    root[k], todo = k, [k]
                    while todo:
                        new = np.flatnonzero(linked[todo.pop()] & (root < 0))
                        root[new] = k
                        todo += new.tolist()
            nodes.append(node)
            links.append(linked.sum(axis=1).astype(np.int64))
            roots.append(node[root])
            held += len(node)
            if held > 50_000:
                yield flush()
                nodes, links, roots, held = [], [], [], 0
        if held:
            yield flush()

    return run


def streamed(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


# --- the join ------------------------------------------------------------------------------


def similar_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, scratch: Scratch | None = None, verdicts: bool = False) -> DataFrame:
    """Per row: the key, class_id (least key of its connected component of links), n_links (other
    shingle sets at the threshold or above) and n_copies (rows with the same shingle set).

    With verdicts also what one_of_each needs, as keys may be null or repeat: text_hash and
    rest_hash, which tell rows apart, and stands (whether the row, or one equal to it in all columns,
    stands for its class; null for texts without shingles)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(quoted(key).alias("key"), F.xxhash64(quoted(text)).alias("h"), quoted(text).cast("string").alias("text"), (_rest_hash(docs, text) if verdicts else F.lit(0).cast("long")).alias("r"))
    long = T.LongType()
    schema = T.StructType([rows.schema["key"], *[T.StructField(c, long) for c in ("h", "r", "node", "size")], T.StructField("sig", T.BinaryType())])
    signed = scratch.keep(rows.mapInArrow(_sets, schema), "signed")
    least = F.struct(F.col("key").isNull().alias("last"), "key", "h", "r")
    nodes = signed.filter("size > 0").groupBy("node").agg(F.min(least).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("sig").alias("sig"))
    nodes = scratch.keep(nodes.select("node", F.col("first.key").alias("key"), F.col("first.h").alias("h"), F.col("first.r").alias("r"), "copies", "sig"), "nodes")

    # Buckets with two nodes or more; buckets of the same members are one.
    part = lambda b: F.substring("sig", b * ROWS * 4 + 1, ROWS * 4)
    keys = nodes.select("node", F.explode(F.array(*[F.xxhash64(part(b), F.lit(b)) for b in range(BANDS)])).alias("bucket"))
    keys = scratch.keep(keys, "keys")
    full = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.min("node").alias("m")).filter("members > 1")
    full = scratch.keep(full.groupBy("members", "s", "m").agg(F.min("bucket").alias("b")).select("b", "members"), "buckets")
    candidates = scratch.keep(keys.join(full, F.col("bucket") == F.col("b")).select("bucket", "members", "node"), "candidates")
    scratch.drop("keys")
    dealt = in_blocks(candidates.join(nodes.select(F.col("node").alias("n"), "sig").hint("merge"), F.col("node") == F.col("n")), "node", "members", BUCKET_BLOCK)
    plan = needed(threshold, tolerance)
    edges = streamed(dealt.select("bucket", "i", "j", "node", "sig"), "bucket", "i", "j").mapInArrow(_bucket_edges(plan), "a long, b long")
    groups = components(edges.distinct(), scratch, "groups")
    scratch.drop("candidates")
    scratch.drop("buckets")

    # Exact links inside the groups, on one row of each node; of equal rows _members keeps one.
    sizes = scratch.keep(groups.groupBy(F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("members")), "sizes")
    members = groups.join(sizes, F.col("label") == F.col("l")).join(nodes.select(F.col("node").alias("n"), F.col("key").alias("k"), F.col("h").alias("th")), F.col("node") == F.col("n"))
    members = scratch.keep(members.select("node", "label", "members", "k", "th"), "members")
    # Sorted merges at every size: neither texts nor their keys are ever broadcast.
    texts = members.join(rows.hint("merge"), (F.col("h") == F.col("th")) & F.col("key").eqNullSafe(F.col("k"))).select("node", "label", "members", "text")
    sets = texts.mapInArrow(_members, "node long, label long, members long, sets binary")
    blocks = in_blocks(sets, "node", "members", GROUP_BLOCK).select("label", "i", "j", "mine", "node", "sets")
    linked = scratch.keep(streamed(blocks, "label", "i", "j").mapInArrow(_group_links(threshold), "node long, links long, root long"), "linked")
    links = linked.groupBy(F.col("node").alias("n")).agg(F.sum("links").alias("links"))
    classes = components(linked.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch, "classes")

    known = nodes.select("node", "key", "h", "r", "copies").join(classes.select(F.col("node").alias("c"), "label"), F.col("node") == F.col("c"), "left").join(links, F.col("node") == F.col("n"), "left")
    known = known.select("node", "key", "h", "r", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    known = scratch.keep(known, "known")
    for done in ("linked", "members", "sizes", "nodes"):
        scratch.drop(done)
    ids = known.groupBy("label").agg(F.min(least).alias("first"))
    ids = scratch.keep(ids.select(F.col("label").alias("l"), F.col("first.key").alias("class_id"), F.col("first.h").alias("class_h"), F.col("first.r").alias("class_r")), "ids")
    final = scratch.keep(known.join(ids, F.col("label") == F.col("l")).select(F.col("node").alias("n"), "class_id", "class_h", "class_r", "links", "copies"), "final")
    out = signed.select("key", "h", "r", "node", "size").join(final.hint("merge"), (F.col("node") == F.col("n")) & (F.col("size") > 0), "left")
    alone = F.col("size") == 0
    told = [F.col("h").alias("text_hash"), F.col("r").alias("rest_hash"), F.when(~alone, (F.col("h") == F.col("class_h")) & (F.col("r") == F.col("class_r"))).alias("stands")] if verdicts else []
    return out.select(F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), *told)


def _rest_hash(docs: DataFrame, text: str) -> Column:
    """Of all columns of a row but its text."""
    return F.xxhash64(F.to_json(F.struct(*[quoted(c) for c in docs.columns if c != text])))


def one_of_each(docs: DataFrame, classes: DataFrame | None = None, key: str = "doc_id", *, text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of docs for each class: that with the least key (any key comes before null), then by
    hashes of the text and of the other columns. Texts without shingles all stay.

    classes is similar_texts(docs, verdicts=True). Without verdicts it cannot tell rows of one key
    apart and is made again, at this threshold."""
    if classes is None or "stands" not in classes.columns:
        classes = similar_texts(docs, key=key, text=text, threshold=threshold, tolerance=tolerance, verdicts=True)
    ids = [F.col("text_hash").alias("__tsr_h"), F.col("rest_hash").alias("__tsr_r")]
    named = docs.withColumns({"__tsr_th": F.xxhash64(quoted(text)), "__tsr_rh": _rest_hash(docs, text)})
    same = (F.col("__tsr_th") == F.col("__tsr_h")) & (F.col("__tsr_rh") == F.col("__tsr_r"))
    others = classes.filter(~F.col("stands")).select(*ids).distinct()
    repeated = classes.filter("stands").groupBy(*ids).count().filter("count > 1").drop("count")
    if not repeated.limit(1).count():
        return named.join(others, same, "left_anti").select(*map(quoted, docs.columns))
    # Rows equal in all columns: they alone are grouped.
    once = named.join(others.union(repeated), same, "left_anti")
    again = named.join(repeated, same, "left_semi").dropDuplicates(["__tsr_th", "__tsr_rh"])
    return once.union(again).select(*map(quoted, docs.columns))


#: Every pair by its common shingles, without candidates: what the join must find.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(list_zip(w[:-5], w[2:-4], w[3:-3], w[4:-2], w[5:]), lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5])))) END AS s
    FROM words),
signed AS (SELECT doc_id, s, md5(array_to_string(s, chr(10))) AS node, len(s) AS size FROM sets),
nodes AS (SELECT node, any_value(s) AS s, any_value(size) AS size, min(doc_id) AS first, count(*) AS copies FROM signed WHERE size > 0 GROUP BY node),
flat AS (SELECT node, size, unnest(s) AS g FROM nodes),
shared AS (SELECT x.node AS a, y.node AS b, x.size AS na, y.size AS nb, count(*) AS n
    FROM flat x JOIN flat y ON x.g = y.g AND x.node <> y.node AND x.size >= 0.8 * y.size AND y.size >= 0.8 * x.size
    GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 10 * n >= 8 * (na + nb - n)),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS node, min(first) AS class_id FROM reach JOIN nodes ON reach.b = nodes.node GROUP BY a),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, CASE WHEN signed.size = 0 THEN doc_id ELSE class_id END AS class_id,
       CASE WHEN signed.size = 0 THEN 0 ELSE coalesce(counts.n, 0) END AS n_links,
       CASE WHEN signed.size = 0 THEN 1 ELSE copies END AS n_copies
FROM signed LEFT JOIN nodes USING (node) LEFT JOIN classes USING (node) LEFT JOIN counts USING (node)
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_texts(docs)
