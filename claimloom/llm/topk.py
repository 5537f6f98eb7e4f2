"""Exact top-k search by inner product, block at a time.

Each component becomes an integer term weight, floor(scale * x). Documents stand in ranges of
their ids; a range of ``RANGE`` documents meets a chunk of ``CHUNK`` queries in a task, and both are
bounded, so that work is dealt evenly whatever the ids. In a range, blocks of ``BLOCK`` documents keep
their term maxima (and minima, for negative weights of a query). A query's bound for a block is
the sum over terms of the largest product; it takes the blocks in order of falling bounds, scores
each through the block's forward index, and stops when the bound falls below its k-th score.
A bound equal to it is still scored, as a smaller id wins a tie.

Defined cases: vectors that are null, empty, of another length than most, or hold null or
non-finite components take no part, nor do rows without id; zero vectors do; rows that share an
id are one candidate, at its larger score; fewer than k candidates are all returned; an empty
table gives an empty result; other columns are ignored. Sums are exact up to 2**53, and scores
beyond that range are refused by an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import clean, matrix
from .common import stash, table

RANGE, CHUNK, BLOCK = 8192, 4096, 128


def block_search(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, document id, score) of each query's k best of x; both hold whole numbers as float64."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    cuts = np.arange(0, len(x), BLOCK)
    high, low = np.maximum.reduceat(x, cuts), np.minimum.reduceat(x, cuts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    names = np.full((len(q), k), np.iinfo(np.int64).max)
    open_ = np.arange(len(q))
    for step in range(len(cuts)):
        block = turn[open_, step]
        stay = bounds[open_, block] >= best[open_, -1]
        open_, block = open_[stay], block[stay]
        if not len(open_):
            break
        by = np.argsort(block, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            who, b = open_[part], cuts[block[part[0]]]
            own = ids[b : b + BLOCK]
            scores = q[who] @ x[b : b + BLOCK].T
            scores[q_ids[who][:, None] == own[None]] = -np.inf
            scores = np.concatenate([best[who], scores], 1)
            named = np.concatenate([names[who], np.broadcast_to(own, (len(who), len(own)))], 1)
            rank = np.lexsort([named, -scores], axis=1)[:, : k]
            best[who], names[who] = np.take_along_axis(scores, rank, 1), np.take_along_axis(named, rank, 1)
    got = np.isfinite(best)
    return np.nonzero(got)[0], names[got], best[got]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of which is_query (of column id) holds."""
    spark = vectors.sparkSession
    rows = clean(vectors, key, vector).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    # repeated ids: each distinct vector of an id once
    rows = stash(rows.dropDuplicates(["id", "v"]), "weights")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranges = -(-n // RANGE)
    ranged = stash(rows.repartitionByRange(ranges, "id").withColumn("range", F.spark_partition_id()), "ranges")
    there = [r["range"] for r in ranged.select("range").distinct().orderBy("range").collect()]  # n / RANGE numbers
    queries = ranged.where(is_query).groupBy("id").agg(F.min("v").alias("v"))  # of an id's vectors the least, so that reruns agree
    chunks = max(1, -(-queries.count() // CHUNK))
    left = ranged.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("range", F.explode(F.array(*[F.lit(i) for i in there]) if len(there) <= 1000 else F.sequence(F.lit(0), F.lit(max(there)))))

    def search(docs: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(docs) and len(asking):
            ids, x = docs["id"].to_numpy(), matrix(docs["v"])
            q_ids, q = asking["id"].to_numpy(), matrix(asking["v"])
            if x.shape[1] * np.abs(x).max() * max(np.abs(q).max(), 1) >= 2**53:
                raise OverflowError("inner products beyond 2**53")
            # more than k of an id's own vectors could crowd others out: keep k and what repeats of ids can take
            spare = k * int(pd.Series(ids).value_counts().iloc[0])
            for low in range(0, len(q), 512):
                place, name, score = block_search(ids, x, q_ids[low : low + 512], q[low : low + 512], spare)
                found.append(pd.DataFrame({"query_id": q_ids[low + place], "vec_id": name, "score": score.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("range", "chunk").cogroup(right.groupBy("range", "chunk")).applyInPandas(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


#: The same by SQL: every query against every row.
SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM w q JOIN w d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
