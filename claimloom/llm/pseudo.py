"""LM scoring by masked pseudo-likelihood.

Tokens are white-space words, lower-cased, named by a 32-bit hash. Exact counts over all documents (a
distributed aggregation) give the vocabulary: the ``Lexicon.own`` most frequent tokens are leaves of
their own, and the others share leaves by hash, ``own / 4`` of them; both numbers grow with the
square root of the number of distinct tokens, up to ``Settings.most``. A Huffman tree over the leaves
makes P(leaf) a product of binary decisions, each a logistic regression on the hidden layer of a
network trained in numpy: the two tokens to the left and the two to the right each have a row of their
position's table, and their sum goes through tanh. The masked token itself is never an input.
Every decision down to the leaf depends on the context; within a shared leaf the distinct tokens that
share it are alike. Before training, the decisions' biases give exactly the leaves' counts.

Training is spread over the corpus and takes every window once. Documents are dealt by hash into
shards of about ``Settings.shard`` bytes and sorted, so that the outcome does not depend on how the input is
partitioned; shards are dealt into ``Settings.rounds`` rounds. In a round every shard runs gradient descent from
the common weights, and what its rows moved by is averaged, weighed by how often each shard met them, in a tree of two levels. The
driver holds the leaves' counts and the weights, bounded by ``most``.

A document's score is the sum of its tokens' conditional log-probabilities; mean is that by token.

Defined cases: a null or empty text has 0 tokens, sum 0 and a null mean; at its ends a window
has a row for nothing; texts of any length are read whole; repeated rows are scored alike (and
each is trained on); rows alike in every column stand in one shard; an empty table gives an empty table; other columns pass through, added
names that clash get a leading underscore.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, small_batches, stash, table

OFFSETS = (-2, -1, 1, 2)
#: Rows of weights in a piece that travels on its own.
PIECE = 1024
#: Beyond so many, shards grow instead.
MOST_SHARDS = 20_000


@dataclass(frozen=True)
class Settings:
    most: int = 1 << 17  # leaves of tokens of their own, at most
    width: int = 8
    rounds: int = 3
    rate: float = 0.05
    batch: int = 4096
    shard: int = 6_000_000  # bytes of text

    def own(self, distinct: int) -> int:
        """Leaves of their own for so many distinct tokens."""
        return min(self.most, 1 << max(4, math.ceil(math.log2(8 * math.sqrt(max(distinct, 1))))))


class Lexicon:
    """The leaves, and the path of each in the tree."""

    def __init__(self, own: np.ndarray, counts: np.ndarray, shared: np.ndarray, distinct: np.ndarray):
        """own: sorted hashes of leaves of their own, and their counts; shared, distinct: tokens and distinct tokens of each shared leaf."""
        self.own, self.shared = own, len(shared)
        mass = np.concatenate([counts, shared]).astype(float)
        self.leaves = len(mass)
        self.alike = np.concatenate([np.zeros(len(own)), -np.log(np.maximum(distinct, 1))])  # log-probability within a leaf
        heap = [(m, i) for i, m in enumerate(np.maximum(mass, 0.5).tolist())]  # an empty leaf counts as half a token
        heapq.heapify(heap)
        up, side, bias, n = np.zeros(2 * self.leaves, np.int64), np.zeros(2 * self.leaves, np.float32), [], self.leaves
        while len(heap) > 1:
            (m0, a), (m1, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a] = up[b] = n
            side[b] = 1
            bias.append(math.log(m1 / m0))
            heapq.heappush(heap, (m0 + m1, n))
            n += 1
        self.bias = np.array(bias, np.float32)  # of each inner node: log-odds of its second child
        nodes, bits, at, leaf = [], [], np.arange(self.leaves), np.arange(self.leaves)
        while len(at) and n > self.leaves:
            at_bit, at = side[at], up[at]
            nodes.append((leaf, at - self.leaves, at_bit))
            leaf, at = leaf[at < n - 1], at[at < n - 1]
        order = np.concatenate([x for x, _, _ in nodes]) if nodes else np.zeros(0, int)
        by = np.argsort(order, kind="stable")
        self.nodes = np.concatenate([x for _, x, _ in nodes])[by].astype(np.int32) if nodes else np.zeros(0, np.int32)
        self.bits = np.concatenate([x for _, _, x in nodes])[by] if nodes else np.zeros(0, np.float32)
        self.long = np.bincount(order, minlength=self.leaves)
        self.first = np.cumsum(self.long) - self.long

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Leaves of tokens; a token never counted stands in a shared leaf."""
        at = np.searchsorted(self.own, hashes)
        at[at == len(self.own)] = 0
        return np.where(self.own[at] == hashes, at, len(self.own) + hashes % self.shared).astype(np.int64)

    def paths(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inner nodes on the ways to leaves, the sides taken, how long each way is, and where it begins."""
        long = self.long[leaves]
        start = np.cumsum(long) - long
        at = np.arange(start[-1] + long[-1]) + np.repeat(self.first[leaves] - start, long)
        return self.nodes.take(at), self.bits.take(at), long, start


class Network:
    """One matrix of rows (width, bias): a table for each position, the inner nodes, the hidden layer's bias."""

    def __init__(self, s: Settings, words: Lexicon, rows: np.ndarray | None = None, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.s, self.words = s, words
        self.table = words.leaves + 1  # the last row is for nothing
        self.node = len(OFFSETS) * self.table
        if rows is not None:
            self.rows = rows
            return
        self.rows = np.zeros((self.node + len(words.bias) + 1, s.width + 1), np.float32)
        self.rows[: self.node, :-1] = rng.normal(0, 0.1, (self.node, s.width))
        self.rows[self.node : -1, -1] = words.bias

    def hidden(self, places: np.ndarray) -> np.ndarray:
        """places: (windows, positions) of rows."""
        h = self.rows.take(places[:, 0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += self.rows.take(places[:, k], axis=0)
        return np.tanh(h[:, :-1] + self.rows[-1, :-1])

    def log_p(self, places: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Log-probability of each leaf."""
        if not len(self.words.bias):
            return np.zeros(len(leaves))
        nodes, bits, long, start = self.words.paths(leaves)
        own = self.rows.take(nodes + self.node, axis=0)
        z = np.einsum("ij,ij->i", own[:, :-1], np.repeat(self.hidden(places), long, axis=0)) + own[:, -1]
        p = 1 / (1 + np.exp(np.clip(z * (1 - 2 * bits), -16, 16)))
        return np.log(np.multiply.reduceat(p, start, dtype=np.float64))

    def gradients(self, places: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows touched, how often, and the sums of their gradients of the negative log-probability."""
        h = np.ascontiguousarray(self.hidden(places).T)  # by column, as all sums below
        nodes, bits, long, start = self.words.paths(leaves)
        own, h_own = np.ascontiguousarray(self.rows.take(nodes + self.node, axis=0).T), np.repeat(h, long, axis=1)
        z = np.einsum("ij,ij->j", own[:-1], h_own) + own[-1]
        wrong = 1 / (1 + np.exp(-np.clip(z, -16, 16))) - bits
        own[:-1] *= wrong
        d_h = np.add.reduceat(own[:-1], start, axis=1) * (1 - h * h)
        often = np.bincount(nodes, minlength=len(self.words.bias))
        met = np.flatnonzero(often)
        h_own *= wrong
        columns = [np.bincount(nodes, weights=x, minlength=len(often)).take(met) for x in (*h_own, wrong)]
        near, whose = np.unique(places.T.ravel(), return_inverse=True)  # no two positions share rows
        beside = [np.bincount(whose, weights=np.tile(x, len(OFFSETS)), minlength=len(near)) for x in d_h]
        sums = np.zeros((len(met) + len(near) + 1, len(h) + 1), np.float32)
        sums[: len(met)] = np.column_stack(columns)
        sums[len(met) : -1, :-1] = np.column_stack(beside)
        sums[-1, :-1] = d_h.sum(1)
        counts = np.concatenate([often[met], np.bincount(whose, minlength=len(near)), [len(leaves)]])
        return np.concatenate([self.node + met, near, [len(self.rows) - 1]]), counts, sums

    def step(self, places: np.ndarray, leaves: np.ndarray, often: np.ndarray) -> None:
        """A row moves by its gradients' sum over the root of their number: rare rows learn as fast as frequent ones."""
        rows, n, sums = self.gradients(places, leaves)
        self.rows[rows] -= (self.s.rate / np.sqrt(n)).astype(np.float32)[:, None] * sums
        often[rows] += n


def cut(leaves: np.ndarray, table: int, chunk: int = 8192) -> Iterator[np.ndarray]:
    """A text's leaves in parts, each with two more on either side; the last row of a table stands for nothing."""
    padded = np.concatenate([[table - 1] * 2, leaves, [table - 1] * 2])
    for low in range(0, len(leaves), chunk):
        yield padded[low : low + chunk + 4]


def places_of(parts: list[np.ndarray], table: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the parts' windows (tokens, positions), and their leaves."""
    places = np.concatenate([np.column_stack([x[2 + o : len(x) - 2 + o] + k * table for k, o in enumerate(OFFSETS)]) for x in parts])
    return places, np.concatenate([x[2:-2] for x in parts])


class Reader:
    """Texts to hashes of tokens; known tokens stay in a table that starts anew when full."""

    def __init__(self, room: int = 100_000):
        self.room, self.known = room, {}

    def hashes(self, text: str | None) -> np.ndarray:
        tokens = text.lower().split() if text else []
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > self.room:
                self.known.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.known[tokens[i]] = zlib.crc32(tokens[i].encode("utf-8", "surrogatepass"))
        return np.array(found, np.uint32)


def read_tokens(docs: DataFrame, text: str, keep: list[str], s: Settings) -> tuple[DataFrame, list[str]]:
    """docs (its columns keep) with names: tokens, shard and round, as a written table; a shard's rows stand together, in an order of their own."""
    names = fresh(keep, "tokens_", "shard_", "order_", "round_")
    n_tokens, n_shard, n_order, n_round = names
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = min(MOST_SHARDS, max(s.rounds, math.ceil(size / s.shard)))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(n_tokens, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                read = [reader.hashes(t).tobytes() for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(read, pa.binary())], names=[*keep, n_tokens])
        reader = None
        give_back()

    plain = [f.name for f in docs.select(*keep).schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    rows = docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
    order = F.xxhash64(n_tokens, *plain)
    rows = rows.withColumn(n_order, order).withColumn(n_shard, F.pmod(F.xxhash64(n_order), F.lit(shards)).cast("int")).withColumn(n_round, F.col(n_shard) % s.rounds)
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stash(rows.repartition(parts, n_shard).sortWithinPartitions(n_shard, n_order), "tokens"), names


def lexicon_of(rows: DataFrame, tokens: str, s: Settings) -> Lexicon:
    """The vocabulary, by exact counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, np.uint32))
                n += len(held[-1])
                if n > 2_000_000:
                    yield counted()
                    held, n = [], 0
        if n:
            yield counted()

    counts = stash(rows.select(tokens).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    own = s.own(counts.count())
    shared = own // 4
    top = counts.orderBy(F.desc("n"), "token").limit(own).toArrow()
    hashes, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(hashes)
    hashes, n = hashes[order].astype(np.uint32), n[order]
    rest = counts.groupBy((F.col("token") % shared).alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("d")).toArrow()  # shared rows
    mass, distinct, leaf = np.zeros(shared), np.zeros(shared), rest.column("leaf").to_numpy()
    mass[leaf], distinct[leaf] = rest.column("n").to_numpy(), rest.column("d").to_numpy()
    at = (hashes % shared).astype(np.int64)
    mass -= np.bincount(at, weights=n, minlength=shared)
    distinct -= np.bincount(at, minlength=shared)
    if not len(hashes):
        hashes, n = np.zeros(1, np.uint32), np.zeros(1)
    return Lexicon(hashes, n, mass, distinct)


def train(rows: DataFrame, names: list[str], s: Settings, words: Lexicon) -> Network:
    spark, net = rows.sparkSession, Network(s, words)
    tokens, shard, _, turn = names
    held_words = spark.sparkContext.broadcast(words)
    shards = int(rows.agg(F.max(shard)).first()[0] or 0) + 1
    salts = math.ceil(math.sqrt(shards))
    size = s.width + 1
    for r in range(s.rounds):
        held = spark.sparkContext.broadcast(net.rows)

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            common, now, own, often, waiting, n = held.value, None, None, None, [], 0

            def flush(least: int) -> None:
                nonlocal waiting, n
                if n and n >= least:
                    places, leaves = places_of(waiting, own.table)
                    for low in range(0, len(leaves), s.batch):
                        own.step(places[low : low + s.batch], leaves[low : low + s.batch], often)
                    waiting, n = [], 0

            def moved() -> Iterator[pa.RecordBatch]:
                flush(1)
                some = np.flatnonzero(often)
                if not len(some):
                    return
                cuts = np.flatnonzero(np.diff(some // PIECE)) + 1
                parts = np.split(some, cuts)
                delta = [((own.rows[x].astype(np.float64) - common[x]) * often[x][:, None]).astype(np.float32).tobytes() for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(x[0]) // PIECE for x in parts], pa.int32()), pa.array([now] * len(parts), pa.int32()),
                        pa.array([(x % PIECE).astype(np.int16).tobytes() for x in parts], pa.binary()), pa.array([often[x].astype(np.float64).tobytes() for x in parts], pa.binary()), pa.array(delta, pa.binary()),
                    ],
                    names=["piece", "shard", "at", "n", "d"],
                )

            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if k != now:
                        if now is not None:
                            yield from moved()
                        now, own = k, Network(s, held_words.value, common.copy())
                        often = np.zeros(len(common), np.int64)
                    for part in cut(held_words.value.ids(np.frombuffer(x, np.uint32)), own.table):
                        waiting.append(part)
                        n += len(part) - 4
                        flush(s.batch)
            if now is not None:
                yield from moved()
            own = common = None
            give_back()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of each (piece, shard), from rows sorted so."""
            last, n, d = None, None, None
            for batch in batches:
                for key, at, own_n, own_d in zip(zip(*(batch.column(c).to_pylist() for c in (0, 1))), *(batch.column(c).to_pylist() for c in (3, 4, 5))):
                    if key != last:
                        if last is not None:
                            yield summed(last, n, d)
                        last, n, d = key, np.zeros(PIECE), np.zeros((PIECE, size))
                    at = np.frombuffer(at, np.int16)
                    n[at] += np.frombuffer(own_n, np.float64)
                    d[at] += np.frombuffer(own_d, np.float32).reshape(-1, size)
            if last is not None:
                yield summed(last, n, d)

        def summed(key: tuple[int, int], n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(n)
            columns = [key[0]], [key[1]], [at.astype(np.int16).tobytes()], [n[at].tobytes()], [d[at].astype(np.float32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["piece", "shard", "at", "n", "d"])

        kind = "piece int, shard int, at binary, n binary, d binary"
        order = ["piece", "salt", "shard", "at", "n", "d"]
        moves = rows.where(F.col(turn) == r).select(shard, tokens).mapInArrow(learn, kind).withColumn("salt", F.col("shard") % salts).select(*order)
        first = moves.repartition("piece", "salt").sortWithinPartitions("piece", "salt", "shard").mapInArrow(add, kind).withColumn("salt", F.lit(0)).select(*order)
        second = first.repartition("piece").sortWithinPartitions("piece", "salt", "shard").mapInArrow(add, kind)
        for x in second.toArrow().to_pylist():  # the weights, once
            at = np.frombuffer(x["at"], np.int16).astype(np.int64) + x["piece"] * PIECE
            net.rows[at] += (np.frombuffer(x["d"], np.float32).reshape(-1, size) / np.frombuffer(x["n"], np.float64)[:, None]).astype(np.float32)
    return net


def log_likelihoods(net: Network, texts: list[np.ndarray], chunk: int = 8192) -> list[np.ndarray]:
    """Conditional log-probability of each token of each text's hashes."""
    leaves = [net.words.ids(x) for x in texts]
    out, waiting, n = [np.zeros(0)], [], 0

    def flush() -> None:
        nonlocal waiting, n
        if n:
            out.append(net.log_p(*places_of(waiting, net.table)))
            waiting, n = [], 0

    for x in leaves:
        for part in cut(x, net.table, chunk):
            if n + len(part) - 4 > chunk:
                flush()
            waiting.append(part)
            n += len(part) - 4
    flush()
    each = np.split(np.concatenate(out), np.cumsum([len(x) for x in leaves])[:-1])
    return [p + net.words.alike[x] for p, x in zip(each, leaves)]


def score(docs: DataFrame, text: str = "text", s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with n_tokens, log_likelihood (the sum) and mean_log_likelihood."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    rows, names = read_tokens(docs, text, keep, s)
    held = docs.sparkSession.sparkContext.broadcast(train(rows, names, s, lexicon_of(rows, names[0], s)))
    added = fresh(keep, "n_tokens", "log_likelihood", "mean_log_likelihood")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                read = [np.frombuffer(x, np.uint32) for x in batch.column(len(keep)).to_pylist()]
                total = [float(x.sum()) for x in log_likelihoods(net, read)]
                n = [len(x) for x in read]
                new = [pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array([t / k if k else None for t, k in zip(total, n)], pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, *added])
        net = None
        give_back()

    return rows.select(*keep, names[0]).mapInArrow(run, schema)


def op4_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
