"""Connected components: bounded bundles of links are contracted within tasks, the rest by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Links that a task contracts at once.
BUNDLE = 1_000_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of links (a, b), sorted, and for each the smallest id that it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            return ids, ids[up]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to stars: each id of a bundle with the smallest id that it reaches there."""
    held, n = [], 0

    def star() -> pa.RecordBatch:
        ids, least = smallest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["node", "component"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BUNDLE:
            yield star()
            held, n = [], 0
    if n:
        yield star()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links, a written table (a, b) of long ids, to rows (node, component): for each node of a link, the smallest id that it reaches. Nothing reaches the driver but counts."""
    bundles = max(1, -(-links.count() // BUNDLE))
    stars = stash(links.coalesce(bundles).mapInArrow(contracted, "node long, component long"), "stars")
    if bundles == 1:
        return stars
    edges, state = stash(stars.where("node <> component").toDF("u", "v").distinct(), "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: of u's larger neighbours, and small star: of u and its smaller ones, each goes to u's least
        star = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stash(ends.union(edges.select("v", "v")).union(stars.where("node = component")).groupBy("node").agg(F.min("component").alias("component")), "found")
