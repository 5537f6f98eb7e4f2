"""MinHash near-duplicates by an LSH forest.

1. Every document becomes a set of hashed five-word shingles and a MinHash signature.
   Documents with one set are one node, named by the smallest id, before anything is paired:
   exact copies, however many, cost a partial aggregation.
2. The forest has several orders (trees) of the signature. Nodes that share a tree's first
   ``DEPTH`` values stand in one region, the shallowest subtree that is asked; regions of one
   are dropped by a count. All trees' regions are sorted together by range, prefix first, so
   that a region of any size is spread over tasks.
3. The longest common prefix of neighbours in that order is measured, and a node's candidates
   are the ``NEAR`` of the ``2 * NEAR`` nodes around it that share the longest prefixes: in a dense
   region that is deep in the tree, in a sparse one down to ``DEPTH``. Candidates whose signatures
   agree in too few places are passed over, of a batch's candidates the spanning forest of
   best agreement is kept, and full sets decide what is a link.
4. The ascent: regions that still hold several components are open, and what their prefixes
   were too shallow for is compared. A node's home is the largest open region that its regions reach, so that a family's
   regions in all trees come to one home; there, full sets are compared across components within the task, which gives out
   no more links than join components. What pairs an open region holds across homes are confirmed
   singly, each in the first tree that shows it. Large groups are dealt out as pairs of
   blocks of bounded rows and shingles, so that no task holds a group of unbounded size.

The search for candidates is a sketch throughout, the ascent too: at similarity 0.75 a pair shares
no region of 32 trees of depth 4 with probability 5e-6, and its signatures agree in fewer than
``AGREE`` of 128 values with 6e-6; more similar pairs are missed less. Links are exact: full sets confirm them.

Defined cases: a text without words (null, empty, blank) has an empty set and is linked with
nothing; fewer than five words are one shingle; rows that share an id are one document
(linked); a null id has no component and stays; ties do not occur, as the smallest id names a
component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_ids, give_back, small_batches, stash, table
from .components import components
from .shingles import Shingler, signatures

TREES, DEPTH, SLOTS, NEAR, BLOCK = 32, 4, 128, 8, 2048
#: Values of an order after the first DEPTH that nodes are sorted by, and shingles that a block may hold.
SORTED, BLOCK_SHINGLES = 16, 1 << 22
#: Of 128 values so many must agree: 4.4 standard deviations below what 0.75 gives.
AGREE = 74
ORDERS = np.stack([np.random.default_rng(100 + t).permutation(SLOTS) for t in range(TREES)])
_first = np.random.default_rng(99).permutation(SLOTS).reshape(TREES, DEPTH)  # no two trees begin with one value
for _t in range(TREES):
    ORDERS[_t] = np.concatenate([_first[_t], [i for i in ORDERS[_t] if i not in set(_first[_t].tolist())]])


def region_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, TREES) int64: a tree's number and first values, mixed."""
    with np.errstate(over="ignore"):
        h = np.arange(1, TREES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(sig), 1), np.uint64)
        for k in range(DEPTH):
            h = (h ^ sig[:, ORDERS[:, k]].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def sketch(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, sig) of docs: set_id names the set, sig holds SLOTS 16-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
                sigs = signatures(sets, SLOTS).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sigs], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_id", "sig"],
                )
        shingler = None
        give_back()

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, sig binary")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that nodes, a written table of ids, names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["node", "shingles"])

    few = by_ids(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), nodes, "node", "left_semi")
    return few.mapInArrow(run, "node long, shingles array<long>")


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of written pairs (a, b), those whose full sets have 100 * intersection >= 75 * union."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids", few=True)
    sets = stash(full_sets(docs, ids), "sets")
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    near = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return near.where(100 * F.col("both") >= 75 * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b").distinct()


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """key, tree, node, n, sig of a batch of region rows."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    sig = np.frombuffer(b"".join(column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
    return *(column(c).to_numpy(zero_copy_only=False) for c in ("key", "tree", "node", "n")), sig


def _alike(n: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many values the signatures of rows i and j agree; -1 where the sizes of the sets rule a link out."""
    out = np.full(len(i), -1)
    fits = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= 75 * np.maximum(n[i], n[j]))
    for low in range(0, len(fits), 65536):
        part = fits[low : low + 65536]
        out[part] = (sig[i[part]] == sig[j[part]]).sum(1)
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def longest_prefixes(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many values each row's order shares with that of the row before; 0 in another region."""
    out = np.zeros(len(key), np.int64)
    same = rest[1:] == rest[:-1]
    out[1:] = np.where(key[1:] == key[:-1], DEPTH + np.minimum.accumulate(same, axis=1).sum(1), 0)
    return out


def by_longest_prefix(key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in sorted rows: of the 2 * NEAR rows around each, the NEAR of one region with the longest common prefixes; nearer ones first among equals."""
    step, n = longest_prefixes(key, rest), len(key)
    # shared[d]: prefix that row j has in common with row j - d - 1
    shared, now = np.zeros((NEAR, n), np.int64), step.copy()
    for d in range(min(NEAR, n)):
        if d:
            now[d:] = np.minimum(now[d:], step[: n - d])
            now[:d] = 0
        shared[d] = now
    back, ahead = shared, np.zeros_like(shared)
    for d in range(min(NEAR, n - 1)):
        ahead[d, : n - d - 1] = shared[d, d + 1 :]
    both = np.stack([back, ahead], 1).reshape(2 * NEAR, n)  # by distance, before and after
    turn = np.argsort(-both, axis=0, kind="stable")[:NEAR]
    taken = np.zeros_like(both, bool)
    np.put_along_axis(taken, turn, True, axis=0)
    taken &= both > 0
    taken = taken.reshape(NEAR, 2, n)
    pairs = [np.zeros((2, 0), np.int64)]
    for d in range(min(NEAR, n - 1)):
        j = np.flatnonzero(taken[d, 0, d + 1 :] | taken[d, 1, : n - d - 1]) + d + 1
        pairs.append(np.stack([j - d - 1, j]))
    i, j = np.concatenate(pairs, axis=1)
    return i, j


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by region and order: candidate pairs of nodes with long common prefixes, in spanning forests."""
    last: tuple | None = None
    for batch in batches:
        rest = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("rest")).to_pylist()), ">u2").reshape(-1, SORTED)
        key, _, node, n, sig = _rows(batch)
        rows = (key, node, n, sig, rest)
        if last is not None:
            rows = tuple(np.concatenate([x, y]) for x, y in zip(last, rows))
        key, node, n, sig, rest = rows
        new = len(key) - batch.num_rows
        last = tuple(x[-2 * NEAR :] for x in rows)
        i, j = by_longest_prefix(key, rest)
        some = (j >= new) & (node[i] != node[j])
        i, j = i[some], j[some]
        alike = _alike(n, sig, i, j)
        some = alike >= AGREE
        alike, i, j = alike[some], i[some], j[some]
        if not len(i):
            continue
        order = np.argsort(-alike, kind="stable")
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        keep = []
        for k, x, y in zip(order.tolist(), node[i[order]].tolist(), node[j[order]].tolist()):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(k)
        yield _pairs(node[i[keep]], node[j[keep]])


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, lo, hi): every pair of one group, two components and two homes whose signatures agree, in the first tree that shows it."""
    for group in runs(batches, "key"):
        home = group.column("home").to_numpy()
        if (home == home[0]).all():
            continue
        tree, node, n, component, block, lo, hi = (group.column(c).to_numpy() for c in ("tree", "node", "n", "component", "block", "lo", "hi"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        out_a, out_b = [], []
        for x in range(len(node) - 1):
            j = np.arange(x + 1, len(node))
            j = j[(component[j] != component[x]) & (home[j] != home[x])]
            if lo[0] != hi[0]:
                j = j[block[j] != block[x]]
            if len(j):
                j = j[_alike(n, sig, np.full(len(j), x), j) >= AGREE]
            for t in range(int(tree[0])) if len(j) else ():
                first = ORDERS[t, :DEPTH]
                j = j[(sig[j][:, first] != sig[x, first]).any(1)]
            if len(j):
                out_a.append(np.full(len(j), node[x]))
                out_b.append(node[j])
        if out_a:
            yield _pairs(np.concatenate(out_a), np.concatenate(out_b))


def joined(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """df with the columns of a written table that has each key once: by broadcast if that is small, else by a shuffle whose hot keys adaptive execution splits."""
    if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = rows.hint("broadcast")
    return df.join(rows, key)


def home_regions(open_: DataFrame) -> DataFrame:
    """(node, home): the largest region that a node's regions reach through their nodes. A family's regions in the several trees so come to one home.

    Size and half of the key make one number, whose maxima are taken before anything is shuffled; regions that share it share a home."""
    size = F.shiftleft(F.col("m"), 32).bitwiseOR(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    first = open_.groupBy("node").agg(F.max(size).alias("h"))
    second = stash(open_.select("key", "node").join(first, "node").groupBy("key").agg(F.max("h").alias("h")), "homes", few=True)
    return joined(open_.select("key", "node"), second, "key").groupBy("node").agg(F.max("h").alias("home"))


def deal(rows: DataFrame, key: str, parts: str, width: int) -> DataFrame:
    """rows grouped by key, each group in as many blocks as parts says, as pairs (lo, hi) of blocks, sorted."""
    dealt = (
        rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(parts)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
        .withColumn("lo", F.least("block", "other"))
        .withColumn("hi", F.greatest("block", "other"))
    )
    return dealt.repartition(width, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def blocks(rows: str, shingles: str | None = None):
    """Of how many blocks a group of so many rows and shingles is."""
    by_rows = F.ceil(F.col(rows) / BLOCK)
    return (F.greatest(by_rows, F.ceil(F.col(shingles) / BLOCK_SHINGLES)) if shingles else by_rows).cast("int")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each (key, lo, hi), from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "lo", "hi")]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if low == high:
                continue
            now = tuple(x[low] for x in names)
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(low, high - low))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def within_homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows with full sets sorted by (home, lo, hi): links between components, found exactly; no more than join them."""
    for group in runs(batches, "home"):
        if group.num_rows < 2:
            continue
        node, component, block, lo, hi = (group.column(c).to_numpy() for c in ("node", "component", "block", "lo", "hi"))
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        lists = group.column("shingles").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        _, flat = np.unique(flat, return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(n)])
        mark = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)
        names, label = np.unique(component, return_inverse=True)
        top = np.arange(len(names))  # the component that each now belongs to
        out_a, out_b = [], []
        for x in range(len(node) - 1):
            j = np.arange(x + 1, len(node))
            j = j[top[label[j]] != top[label[x]]]
            if lo[0] != hi[0]:
                j = j[block[j] != block[x]]
            if len(j):
                j = j[_alike(n, sig, np.full(len(j), x), j) >= AGREE]
            if not len(j):
                continue
            own = flat[ends[x] : ends[x + 1]]
            mark[own] = True
            for low in range(0, len(j), 512):
                part = j[low : low + 512]
                part = part[top[label[part]] != top[label[x]]]
                if not len(part):
                    continue
                rows = np.concatenate([flat[ends[k] : ends[k + 1]] for k in part])
                both = np.add.reduceat(mark[rows].astype(np.int64), np.concatenate([[0], np.cumsum(n[part])[:-1]]))
                for k in part[100 * both >= 75 * (n[x] + n[part] - both)]:
                    if top[label[k]] != top[label[x]]:
                        top[top == top[label[k]]] = top[label[x]]
                        out_a.append(node[x])
                        out_b.append(node[k])
            mark[own] = False
        if out_a:
            yield _pairs(np.array(out_a), np.array(out_b))


def forest(nodes: DataFrame) -> DataFrame:
    """A written table of the rows (key, tree, node, n, sig, m, rest) of all regions of more than one node: m is the region's size, rest the order's next values."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            node = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(region_keys(sig).ravel()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(sig))), pa.array(node)], names=["key", "tree", "node"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tree, _, _, sig = _rows(batch)
            rest = np.take_along_axis(sig, ORDERS[tree][:, DEPTH : DEPTH + SORTED], 1).astype(">u2")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in rest], pa.binary())], names=[*batch.schema.names, "rest"])

    placed = nodes.select("node", "sig").mapInArrow(keys, "key long, tree int, node long")
    sizes = stash(placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes", few=True)
    shared = joined(placed, sizes, "key").join(nodes.select("node", "n", "sig"), "node")
    return stash(shared.select("key", "tree", "node", "n", "sig", "m").mapInArrow(ordered, "key long, tree int, node long, n long, sig binary, m long, rest binary"), "regions")


def candidates(regions: DataFrame, width: int) -> DataFrame:
    """A written table of the forest's candidate pairs (a, b)."""
    walk = regions.select("key", "tree", "node", "n", "sig", "rest").repartitionByRange(width, "key", "rest").sortWithinPartitions("key", "rest")
    return stash(walk.mapInArrow(neighbours, "a long, b long").distinct(), "pairs", few=True)


def ascent(docs: DataFrame, regions: DataFrame, pairs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """A written table of links (a, b) between components that still share a region."""
    component = F.coalesce("component", "node")
    narrow = regions.select("key", "node").join(found, "node", "left").groupBy("key")
    mixed = stash(narrow.agg(F.min(component).alias("c0"), F.max(component).alias("c1")).where("c0 <> c1").select("key"), "mixed", few=True)
    open_ = by_ids(regions.drop("rest"), mixed, "key", "left_semi").join(found, "node", "left").withColumn("component", component)
    open_ = stash(open_, "open")
    homes = stash(home_regions(open_), "homes", few=True)
    each = open_.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("component").alias("component"))
    each = stash(each.join(homes, "node"), "each", few=True)
    groups = stash(each.groupBy("home").agg(F.count("*").alias("g"), F.sum("n").alias("w")).where("g > 1").select("home", blocks("g", "w").alias("parts")), "groups", few=True)
    at_home = joined(each.drop("n"), groups, "home")
    at_home = at_home.join(full_sets(docs, stash(at_home.select("node"), "ids", few=True)), "node")
    links = stash(deal(at_home, "home", "parts", width).mapInArrow(within_homes, "a long, b long"), "links", few=True)
    apart = deal(open_.join(homes, "node").withColumn("parts", blocks("m")), "key", "parts", width).mapInArrow(across, "a long, b long").distinct()
    more = stash(apart.join(pairs, ["a", "b"], "left_anti"), "more", few=True)
    return links if more.isEmpty() else stash(links.union(confirm(docs, more)), "links", few=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketched = stash(sketch(docs), "sketch")
    sets = sketched.where("doc_id is not null and n_shingles > 0")
    # signatures travel once a set and task, by partial aggregation
    nodes = stash(sets.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "nodes")
    regions = forest(nodes)
    pairs = candidates(regions, width)
    found = components(stash(confirm(docs, pairs), "links", few=True))
    extra = ascent(docs, regions, pairs, found, width)
    if not extra.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(extra))

    of_set = nodes.select("set_id", "node").join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("c"))
    labelled = sketched.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id."""
    gone = stash(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone", few=True)
    return by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)


#: The same in SQL, by every pair of documents that shares a shingle; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
h AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS c FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (total - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM s JOIN r ON node = doc_id GROUP BY doc_id, s
"""
