"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

1. Sources share all words by weight; a target stops at ``cap`` times its source's
   size and what is over goes to the others by weight (``targets``).
2. The corpus is cut into blocks of ``block`` words and the blocks are dealt to the
   sources by highest quotients (``sainte_lague``). One row for each source reaches the
   driver: the recipe, not the corpus.
3. A source is dealt by a seeded hash into shards of about ``shard_words`` words, so that
   a source with a third of all rows is many tasks. Its blocks are dealt to its shards
   the same way, which gives each shard an integer quota.
4. In a shard the documents stand in seeded order as one stream of words; the shard takes
   that many blocks from the start of the stream, beginning anew at its end. ``taken`` is
   what of a document these blocks hold, repeats counted: at most ``cap`` times its size.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, the
last; an empty table gives an empty table; repeated rows each count; rows with one hash and
size are interchangeable. Input columns pass through; added names that clash get a leading
underscore.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, local, stash, table

#: The recipe is broadcast up to so many sources, else joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap * size; the excess is reshared by weight."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else weights[i] * unit
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if out[i] == 0 and i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 k + 1), none above its cap; ties go to the earlier.

    A divisor found by bisection gives nearly all seats at once; a heap of quotients gives the rest."""
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def at(divisor: float) -> list[int]:
        return [min(c, math.floor(v / divisor + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps)]

    low, high = 0.0, 4.0 * max(votes)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    got = at(high * (1 + 1e-9))  # clear of ties, which the heap decides
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps)) if v > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources, which stand by code point, null last."""

    weights: Sequence[float] = (1, 2, 3)
    cap: float = 3.0
    block: int = 16
    shard_words: int = 1 << 20
    seed: int = 20240601


def recipe_of(rows: DataFrame, m: Mix) -> DataFrame:
    """(src_, source_size_, target_, blocks_, parts_) of each source of rows (source, size)."""
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.n or 0) for r in found]
    goal = targets(sizes, [float(m.weights[i % len(m.weights)]) for i in range(len(sizes))], m.cap)
    blocks = sainte_lague(goal, round(sum(sizes) / m.block), [int(m.cap * s) // m.block for s in sizes])
    out = [(r.source, s, g, b, max(1, math.ceil(s / m.shard_words))) for r, s, g, b in zip(found, sizes, goal, blocks)]
    recipe = local(rows.sparkSession, out, pa.schema([("src_", pa.string()), ("source_size_", pa.int64()), ("target_", pa.float64()), ("blocks_", pa.int64()), ("parts_", pa.int64())]))
    return F.broadcast(recipe) if len(out) <= BROADCAST_SOURCES else recipe


def dealt(rows: DataFrame, recipe: DataFrame, m: Mix, source: str, key: str, size: str) -> DataFrame:
    """rows with recipe's columns but blocks_, and hash_ and shard_."""
    seeded = F.xxhash64(F.lit(m.seed), F.col(key), F.col(size))
    joined = rows.join(recipe.drop("blocks_"), F.col(source).eqNullSafe(F.col("src_"))).withColumn("hash_", seeded)
    return joined.withColumn("shard_", F.pmod(F.xxhash64(F.lit(~m.seed), F.col("hash_")), F.col("parts_")))


def quotas(shards: DataFrame, recipe: DataFrame, m: Mix) -> DataFrame:
    """(s_, p_, held_, quota_): the blocks of each shard of shards (src_, shard_, size). A task gets the shards of a source, a row for each shard_words words."""
    own = shards.groupBy("src_", "shard_").agg(F.sum("size").alias("held_")).join(recipe.select(F.col("src_").alias("s_"), "blocks_"), F.col("src_").eqNullSafe(F.col("s_")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources: dict[str | None, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                sources.setdefault(s, []).append(tuple(row))
        for s, rows in sources.items():
            rows.sort()
            held = [h for _, h, _ in rows]
            got = sainte_lague([float(h) for h in held], rows[0][2], [int(m.cap * h) // m.block for h in held])
            columns = [s] * len(rows), [p for p, _, _ in rows], held, got
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 3))], names=["s_", "p_", "held_", "quota_"])

    return own.select("src_", "shard_", "held_", "blocks_").repartition("src_").mapInArrow(deal, "s_ string, p_ long, held_ long, quota_ long")


def whole(m: Mix) -> Column:
    """How often a shard is taken from end to end."""
    return F.expr(f"(quota_ * {m.block}) div greatest(held_, 1)")


def mix(docs: DataFrame, size: str, source: str = "source", key: str = "doc_id", m: Mix = Mix()) -> DataFrame:
    """docs with source_size, target and taken. size names a column of word counts."""
    names = fresh(docs.columns, "source_size", "target", "taken")
    narrow = fresh(docs.columns, "src_", "source_size_", "target_", "parts_", "hash_", "shard_", "s_", "p_", "held_", "quota_", "before_")
    if any(a != b for a, b in zip(narrow, ("src_", "source_size_", "target_", "parts_", "hash_", "shard_", "s_", "p_", "held_", "quota_", "before_"))):
        aside = [f"column{i}" for i in range(len(docs.columns))]
        at = {c: a for c, a in zip(docs.columns, aside)}
        return mix(docs.toDF(*aside), at[size], at[source], at[key], m).toDF(*docs.columns, *names)
    recipe = recipe_of(docs.select(F.col(source).alias("source"), F.col(size).alias("size")), m)
    rows = dealt(docs, recipe, m, source, key, size)
    quota = quotas(rows.select("src_", "shard_", F.col(size).alias("size")), recipe, m)
    before = Window.partitionBy("src_", "shard_").orderBy("hash_", F.col(size)).rowsBetween(Window.unboundedPreceding, -1)
    streamed = rows.withColumn("before_", F.coalesce(F.sum(size).over(before), F.lit(0)))
    rest = F.col("quota_") * F.lit(m.block) - whole(m) * F.col("held_")
    taken = F.col(size) * whole(m) + F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("before_")))
    return streamed.join(quota, F.col("src_").eqNullSafe(F.col("s_")) & (F.col("shard_") == F.col("p_"))).select(
        *docs.columns, F.col("source_size_").alias(names[0]), F.col("target_").alias(names[1]), taken.cast("long").alias(names[2])
    )


def copies(rows: DataFrame, m: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The recipe, and a written table (s_, p_, whole_, cut_): of rows (doc_id, source, size), a written table, those of a shard are
    taken whole whole_ times, and those up to the hash cut_ once more. Rows of one hash go together."""
    recipe = recipe_of(rows, m)
    placed = dealt(rows, recipe, m, "source", "doc_id", "size")
    quota = quotas(placed.select("src_", "shard_", "size"), recipe, m)
    alike = placed.groupBy("src_", "shard_", "hash_").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src_", "shard_").orderBy("hash_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    streamed = alike.withColumn("before_", before).join(quota, F.col("src_").eqNullSafe(F.col("s_")) & (F.col("shard_") == F.col("p_")))
    rest = F.col("quota_") * F.lit(m.block) - whole(m) * F.col("held_")
    cut = F.max(F.when(F.col("before_") + F.col("n") / 2 <= rest, F.col("hash_")))
    return recipe, stash(streamed.groupBy("s_", "p_").agg(F.max(whole(m)).alias("whole_"), cut.alias("cut_")), "cuts", few=True)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    return mix(stash(docs, "mixing-sizes"), "size").select("doc_id", "size", "source_size", "target", "taken")


def mixing_stage(spark, docs: DataFrame, sf_dir: str, m: Mix = Mix()) -> DataFrame:
    """The documents that the mix takes, whole, each as often as it takes them (rounded, three times at most). Texts are not shuffled
    unless the shards are too many to broadcast.

    A document without words takes none of the quota and stays once. Null ids and sources, repeated rows and
    other columns are as in ``mix``; an empty table stays empty."""
    rows = stash(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mixing-sizes")
    recipe, cuts = copies(rows, m)
    few = cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    aside = [f"column{i}" for i in range(len(docs.columns))]
    at = {c: a for c, a in zip(docs.columns, aside)}
    placed = dealt(docs.toDF(*aside).withColumn("size_", words(F.col(at["text"]))), recipe, m, at["source"], at["doc_id"], "size_")
    joined = placed.join(cuts.hint("broadcast") if few else cuts, F.col("src_").eqNullSafe(F.col("s_")) & (F.col("shard_") == F.col("p_")))
    more = F.coalesce(F.col("hash_") <= F.col("cut_"), F.lit(False)).cast("int")
    times = F.when(F.col("size_") == 0, F.lit(1)).otherwise((F.col("whole_") + more).cast("int"))
    taken = joined.withColumn("times_", times).where("times_ > 0").withColumn("times_", F.explode(F.sequence(F.lit(1), F.col("times_"))))
    return taken.select(*aside).toDF(*docs.columns)
