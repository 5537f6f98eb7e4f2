"""Approximate nearest neighbours by inverted lists and an adaptive scan of dimensions.

The index is fitted on a bounded sample (``SAMPLE`` vectors by hash of the id): k-means centres
of about sqrt(n) lists, ``MOST_LISTS`` at most. Every vector goes to its nearest centre's list;
a long list is dealt into blocks of about ``BLOCK`` vectors, and so are the queries that probe it,
so that no task grows with a hot list. A query probes its ``PROBE`` share of lists, nearest first.

Within a block, vectors and queries are turned by one random rotation and compared a block of
columns at a time. After t of d dimensions a candidate is given up if its partial distance, scaled
by d / t, is beyond the tenth best so far by a factor of (1 + EPSILON / sqrt(t)): the hypothesis
that it is among the nearest is rejected. The first bound comes from the query's distances to
the sample. Those that stay get their exact distance on the original vectors.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without id; rows that share an id are one
candidate, at its smaller distance; equal distances go to the smaller id; a table with fewer
than k candidates returns them all, as does a probe that would see no more than k; of a query id's several vectors the least
is asked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, table

#: PROBE suits vectors without structure, as random ones are; clustered ones need far less.
SAMPLE, MOST_LISTS, BLOCK, PROBE, EPSILON, COLUMNS = 16_384, 1024, 4096, 0.7, 2.1, 16


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of usable vectors of the most frequent length."""
    v = F.col(vector).cast("array<double>")
    found = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    length = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("v") == (length.d if length else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def centres(sample: np.ndarray, k: int, seed: int, steps: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.permutation(len(sample))[:k])].copy()
    for _ in range(steps):
        near = squares(sample, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scan(ids: np.ndarray, x: np.ndarray, q_id: int, q: np.ndarray, bound: float, k: int, turn: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of up to k nearest of x to q, and their exact distances. bound: an upper bound of the k-th distance."""
    d = x.shape[1]
    t_q = q @ turn
    places, dists = np.zeros(0, int), np.zeros(0)
    for low in range(0, len(x), 1024):
        live = low + np.flatnonzero(ids[low : low + 1024] != q_id)
        part = np.zeros(len(live))
        for a in range(0, d, COLUMNS):
            b = min(a + COLUMNS, d)
            part += ((turned[live, a:b] - t_q[a:b]) ** 2).sum(1)
            if b < d and np.isfinite(bound):
                stay = part * (d / b) <= (bound * (1 + EPSILON / math.sqrt(b))) ** 2
                live, part = live[stay], part[stay]
        exact = np.sqrt(((x[live] - q) ** 2).sum(1))
        places, dists = np.concatenate([places, live]), np.concatenate([dists, exact])
        best = np.lexsort([ids[places], dists])
        _, first = np.unique(ids[places][best], return_index=True)  # an id once
        best = best[np.sort(first)][:k]
        places, dists = places[best], dists[best]
        if len(places) == k:
            bound = min(bound, dists[-1])
    return places, dists


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", probe: float = PROBE, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of which is_query (of column id) holds."""
    spark = vectors.sparkSession
    rows = clean(vectors, key, vector)
    rows = stash(rows.where(F.exists("v", lambda x: x != 0)), "vectors")
    n = rows.count()
    out = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas().drop_duplicates("id").sort_values("id")  # an id once: the first bound is over ids
    sample, sample_ids = matrix(taken["v"]), taken["id"].to_numpy()
    lists = max(1, min(MOST_LISTS, round(math.sqrt(n)), len(sample)))
    probes = max(1, math.ceil(probe * lists))
    held = spark.sparkContext.broadcast((centres(sample, lists, seed), rotation(sample.shape[1], seed), sample, sample_ids))

    def to_list(batches):
        for batch in batches:
            if len(batch):
                batch["list"] = squares(matrix(batch["v"]), held.value[0]).argmin(1).astype(np.int32)
                yield batch

    listed = stash(rows.mapInPandas(to_list, "id long, v array<double>, list int"), "listed")
    # sizes of at most MOST_LISTS lists, and how many queries come to each
    counted = listed.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    sizes, names = {r["list"]: r["n"] for r in counted}, np.zeros(lists, np.int64)
    for r in counted:
        names[r["list"]] = r["d"]
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))  # of an id's vectors the least, so that reruns agree

    def to_probes(batches):
        centre, _, sample, sample_ids = held.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                q = matrix(part["v"])
                near = np.argsort(squares(q, centre), axis=1, kind="stable")
                asked = np.maximum(probes, np.minimum((names[near].cumsum(1) <= k).sum(1) + 1, lists))  # on until lists of more than k ids are seen
                near = np.concatenate([x[:n] for x, n in zip(near, asked)])
                dist = squares(q, sample)
                dist[part["id"].to_numpy()[:, None] == sample_ids[None]] = np.inf
                bound = np.sqrt(np.sort(dist, axis=1)[:, k - 1]) * (1 + 1e-9) + 1e-9 if dist.shape[1] >= k else np.full(len(part), np.inf)
                yield pd.DataFrame({"id": part["id"].repeat(asked).to_numpy(), "v": part["v"].repeat(asked).to_numpy(), "list": near.astype(np.int32), "bound": bound.repeat(asked)})

    probed = stash(queries.mapInPandas(to_probes, "id long, v array<double>, list int, bound double"), "probed")
    asked = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    deal = spark.createDataFrame([(i, -(-sizes.get(i, 1) // BLOCK), -(-asked.get(i, 1) // BLOCK)) for i in range(lists)], "list int, nv int, nq int")
    deal = F.broadcast(deal)  # MOST_LISTS rows at most
    some = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    left = listed.join(deal, "list").select("list", F.pmod(some, F.col("nv")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("b"), "id", "v")
    right = probed.join(deal, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("a"), F.pmod(some, F.col("nq")).cast("int").alias("b"), "id", "v", "bound")

    def compare(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asking):
            turn = held.value[1]
            x, ids = matrix(own["v"]), own["id"].to_numpy()
            turned = x @ turn
            for q_id, q, bound in zip(asking["id"], asking["v"], asking["bound"]):
                places, dists = scan(ids, x, q_id, np.asarray(q, np.float64), bound, k, turn, turned)
                found.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[places], "score": dists}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInPandas(compare, out)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
