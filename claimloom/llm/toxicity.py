"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of four hashed rows: the word and its first 4, 5 and 6 letters,
so that words never seen lean on their stems. Filters of one, two and three words slide over
the whole text, the maximum of each over all places is kept, and a linear layer on these
gives a logit. Training runs in one task, of which the driver receives the network alone, over
a bounded sample of labelled rows: by hash of the id, ``Settings.rows`` of each label at most,
and ``Settings.bytes`` of text of each, from texts of at most ``Settings.longest`` bytes (longer
ones give way to the next in order). A gradient reaches only the places that gave a maximum.
The first columns of the embeddings start from the sample's smoothed log-odds.

A threshold is calibrated for each language on a part of the labelled rows that training did
not see: a balanced logistic regression on their logits, for all of them and for each language,
whose own threshold counts by its evidence, n / (n + ``Settings.prior``) with n rows of its
rarer label; the common one has the rest. The language is told from the text by its function words; the table's lang, source,
doc_id and labels never enter a score. score = sigmoid(logit - threshold): 0.5 is the threshold.

Defined cases: null and empty texts get the score of a text without words; texts of any
length are read whole, in segments that overlap by two words; a null doc_id is not held out;
repeated rows are scored alike; an empty table gives an empty table; without rows of both
labels every score is the share of toxic labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, small_batches, table, trim_driver

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is that it was for on are with as be at this from by or have not",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les des et du est que qui dans pour une sur pas au avec ne ce il elle sont",
    "es": "el los las que y en una por con para del se no su al lo como más es sus",
}
LANGUAGES = tuple(FUNCTION_WORDS)
VOTES = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split() if sum(w in o.split() for o in FUNCTION_WORDS.values()) == 1}
#: Tables of embeddings, words of padding, words worked on at once.
TABLES, PAD_WORDS, CHUNK = 4, 2, 40_000


@dataclass(frozen=True)
class Settings:
    rows: int = 2500  # labelled rows of each label that training reads
    longest: int = 200_000  # bytes of a text that training reads; longer texts are scored, not trained on
    bytes: int = 12 << 20  # of the sample's texts of each label
    word_bits: int = 18
    stem_bits: int = 16
    width: int = 8
    filters: int = 16  # of each filter width
    epochs: int = 2
    batch: int = 64
    rate: float = 0.01
    prior: float = 25  # rows that the common threshold weighs against a language's own
    seed: int = 3

    @property
    def offsets(self) -> tuple[int, int, int, int, int]:
        """First row of each table of embeddings, and the row of nothing."""
        w, s = 1 << self.word_bits, 1 << self.stem_bits
        return 0, w, w + s, w + 2 * s, w + 3 * s


class Words:
    """Tokens to slots; a slot has the token's four rows and its language's vote. Starts anew when full."""

    def __init__(self, settings: Settings, room: int = 60_000):
        self.s, self.room, self.slot = settings, room, {}
        self.rows = np.full((room + 1, TABLES), settings.offsets[-1], np.int32)
        self.vote = np.full(room + 1, len(LANGUAGES), np.uint8)

    def _add(self, token: str) -> int:
        i = len(self.slot)
        low, high = 0, len(token)
        while low < high and not token[low].isalnum():
            low += 1
        while high > low and not token[high - 1].isalnum():
            high -= 1
        word, o = token[low:high], self.s.offsets
        if word:
            stems = (1 << self.s.stem_bits) - 1
            self.rows[i] = (
                zlib.crc32(word.encode("utf-8", "replace")) & ((1 << self.s.word_bits) - 1),
                *(o[k - 3] + (zlib.crc32(word[:k].encode("utf-8", "replace")) & stems) if len(word) >= k else o[-1] for k in (4, 5, 6)),
            )
        else:
            self.rows[i] = o[-1]
        self.vote[i] = VOTES.get(word, len(LANGUAGES))
        self.slot[token] = i
        return i

    def slots(self, tokens: list[str]) -> np.ndarray:
        found = list(map(self.slot.get, tokens))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    x = self.slot.get(tokens[i])
                    found[i] = self._add(tokens[i]) if x is None else x
        return np.array(found, np.int64)

    def ready(self, more: int) -> bool:
        """Whether so many new tokens fit; else the table is emptied first."""
        if len(self.slot) + more > self.room:
            self.slot.clear()
            return False
        return True


def language(votes: np.ndarray) -> int:
    """The language of most function words; len(LANGUAGES) if there is none."""
    counts = np.bincount(votes, minlength=len(LANGUAGES) + 1)[: len(LANGUAGES)]
    return int(counts.argmax()) if counts.any() else len(LANGUAGES)


class Network:
    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        n = s.offsets[-1] + 1
        self.s = s
        self.e = rng.standard_normal((n, s.width), np.float32) * np.float32(0.05)
        self.e[-1] = 0
        self.w = rng.normal(0, 0.3 / np.sqrt(s.width), (6, s.width, s.filters)).astype(np.float32)  # width 1; 2, 2; 3, 3, 3
        self.b = np.zeros(3 * s.filters, np.float32)
        self.v = rng.normal(0, 0.05, 3 * s.filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def conv(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at each row of x, whose last rows are padding."""
        f, w = self.s.filters, self.w
        y = x @ w.transpose(1, 0, 2).reshape(self.s.width, -1)
        z = np.empty((len(x) - PAD_WORDS, 3 * f), np.float32)
        n = len(z)
        z[:, :f] = y[:n, :f]
        z[:, f : 2 * f] = y[:n, f : 2 * f] + y[1 : n + 1, 2 * f : 3 * f]
        z[:, 2 * f :] = y[:n, 3 * f : 4 * f] + y[1 : n + 1, 4 * f : 5 * f] + y[2 : n + 2, 5 * f :]
        return z

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.v + self.c[0]

    def start_from(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """Log-odds of each row's presence in toxic documents, in a column of its table, and a filter that reads it."""
        n = self.s.offsets[-1] + 1
        counts = np.zeros((2, n), np.float64)
        for rows, label in zip(docs, y):
            counts[int(label), np.unique(rows)] += 1
        totals = np.maximum([(y == 0).sum(), (y == 1).sum()], 1)
        odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
        seen = counts.sum(0)
        odds *= seen / (seen + 2)
        for t in range(TABLES):
            a, b = self.s.offsets[t], self.s.offsets[t + 1]
            self.e[a:b, t] = 0.5 * odds[a:b]
            self.w[0, :, t] = 0
            self.w[0, t, t] = 1
            self.b[t], self.v[t] = -0.75, 0.8
        self.w[0, :, TABLES] = 0
        self.w[0, :TABLES, TABLES] = 0.7
        self.b[TABLES], self.v[TABLES], self.c[0] = -1.0, 0.8, -1.5
        self.e[-1] = 0

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Of the mean weighted logistic loss: by name, and for the embeddings the rows touched (n, TABLES) and what each of them gets (n, width)."""
        s, f = self.s, self.s.filters
        pad = np.full((PAD_WORDS + 1, TABLES), s.offsets[-1], np.int32)
        pooled, seen, low = [], [], 0  # maxima of each text, and the rows of the three words from each maximum on
        while low < len(docs):
            high, n = low, 0
            while high < len(docs) and (high == low or n + len(docs[high]) <= CHUNK):
                n += len(docs[high]) + len(pad)
                high += 1
            rows = np.concatenate([x for d in docs[low:high] for x in (d, pad)])
            bounds = np.cumsum([0, *(len(d) + len(pad) for d in docs[low:high])])
            z = self.conv(self.e[rows].sum(1))
            at = np.stack([a + z[a : b - PAD_WORDS].argmax(0) for a, b in zip(bounds[:-1], bounds[1:])])
            pooled.append(np.take_along_axis(z, at, 0))
            seen.append(rows[at[:, :, None] + np.arange(3)])
            low = high
        seen = np.concatenate(seen)  # (docs, 3 f, 3, TABLES)
        on = np.maximum(np.concatenate(pooled) + self.b, 0)
        p = 1 / (1 + np.exp(-(on @ self.v + self.c[0])))
        d = ((p - y) * weight / len(docs)).astype(np.float32)
        g = d[:, None] * self.v * (on > 0)
        grads = {"v": on.T @ d, "c": d.sum(keepdims=True), "b": g.sum(0), "w": np.zeros_like(self.w)}
        touched, deltas, k = [], [], 0
        for size in (1, 2, 3):
            part = slice((size - 1) * f, size * f)
            for j in range(size):
                rows = seen[:, part, j]
                grads["w"][k] = np.einsum("bf,bfd->df", g[:, part], self.e[rows].sum(2))
                touched.append(rows.reshape(-1, TABLES))
                deltas.append((g[:, part, None] * self.w[k].T[None]).reshape(-1, s.width))
                k += 1
        return grads, np.concatenate(touched), np.concatenate(deltas)

    def train(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """docs: the words' rows, each (words, TABLES)."""
        s = self.s
        rng = np.random.default_rng(s.seed)
        self.start_from(docs, y)
        names = ("w", "b", "v", "c")
        state = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        m_e, v_e = np.zeros_like(self.e), np.zeros_like(self.e)
        weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
        step = 0
        for _ in range(s.epochs):
            order = rng.permutation(len(docs))
            for low in range(0, len(order), s.batch):
                pick = order[low : low + s.batch]
                grads, touched, deltas = self.gradients([docs[i] for i in pick], y[pick], weight[pick])
                step += 1
                fix = s.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name in names:
                    m, v = state[name]
                    m += 0.1 * (grads[name] - m)
                    v += 0.001 * (grads[name] ** 2 - v)
                    getattr(self, name)[...] -= fix * m / (np.sqrt(v) + 1e-8)
                which, where = np.unique(touched.T.ravel(), return_inverse=True)
                sums = np.zeros((len(which), s.width), np.float32)
                for t in range(TABLES):
                    np.add.at(sums, where[t * len(deltas) : (t + 1) * len(deltas)], deltas)
                m_e[which] += 0.1 * (sums - m_e[which])
                v_e[which] += 0.001 * (sums**2 - v_e[which])
                self.e[which] -= fix * m_e[which] / (np.sqrt(v_e[which]) + 1e-8)
                self.e[-1] = 0


@dataclass
class Model:
    net: Network | None
    threshold: np.ndarray  # of each language, and of none
    share: float  # the score of all, if there is no network


class Scorer:
    """Scores texts in a Python worker."""

    def __init__(self, model: Model, chunk: int = CHUNK):
        self.model, self.chunk, s = model, chunk, model.net.s
        self.words = Words(s)
        self.embedded = np.zeros((self.words.room + 1, s.width), np.float32)
        self.filled = 0

    def _embed(self, tokens: list[str]) -> np.ndarray:
        if not self.words.ready(len(tokens)):
            self.filled = 0
        slots = self.words.slots(tokens)
        n = len(self.words.slot)
        if n > self.filled:
            self.embedded[self.filled : n] = self.model.net.e[self.words.rows[self.filled : n]].sum(1)
            self.filled = n
        return slots

    def pooled(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over each whole text, and its language."""
        net, most = self.model.net, []
        votes = np.zeros((len(texts), len(LANGUAGES) + 1), np.int64)
        out = np.full((len(texts), 3 * net.s.filters), -np.inf, np.float32)
        pad = np.zeros((PAD_WORDS + 1, net.s.width), np.float32)

        def flush() -> None:
            if most:
                x = np.concatenate([y for _, e in most for y in (e, pad)])
                bounds = np.cumsum([0, *(len(e) + len(pad) for _, e in most)])[:-1]
                z = net.conv(x)
                # the last two rows before each bound see the next text: they are padding, put out of the running
                for d in (1, 2):
                    z[bounds[1:] - d] = -np.inf
                tops = np.maximum.reduceat(z, bounds, axis=0)
                for (i, _), top in zip(most, tops):
                    np.maximum(out[i], top, out=out[i])
                most.clear()

        held = 0
        for i, text in enumerate(texts):
            tokens = text.lower().split()
            for low in range(0, max(len(tokens), 1), self.chunk):
                part = tokens[max(0, low - PAD_WORDS) : low + self.chunk]
                slots = self._embed(part)
                votes[i] += np.bincount(self.words.vote[slots], minlength=len(LANGUAGES) + 1)
                most.append((i, self.embedded[slots]))
                held += len(part) + len(pad)
                if held > self.chunk:
                    flush()
                    held = 0
        flush()
        counts = votes[:, : len(LANGUAGES)]
        return out, np.where(counts.any(1), counts.argmax(1), len(LANGUAGES))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        pooled, langs = self.pooled(texts)
        x = (self.model.net.logits(pooled) - self.model.threshold[langs]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500))), langs


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def threshold_of(logits: np.ndarray, y: np.ndarray) -> float:
    """Where a logistic regression on the logits, both labels weighing alike, is in doubt."""
    centre, spread = logits.mean(), logits.std() + 1e-9
    x = (logits - centre) / spread
    w = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    at, ridge = np.array([1.0, 0.0]), 1e-4
    columns = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ at, -30, 30)))
        slope = columns.T @ (w * (p - y)) + ridge * at * (1, 0)
        bend = (columns * (w * p * (1 - p))[:, None]).T @ columns + ridge * np.eye(2)
        at -= np.clip(np.linalg.solve(bend, slope), -2, 2)
    place = -at[1] / at[0] if at[0] > 1e-3 else 0.0
    return float(centre + spread * np.clip(place, x.min() - 1, x.max() + 1))


def thresholds(logits: np.ndarray, y: np.ndarray, langs: np.ndarray, prior: float) -> np.ndarray:
    """Of each language, and last of none: its own and the common one, weighed by the rows of its rarer label."""
    common = threshold_of(logits, y)
    out = np.full(len(LANGUAGES) + 1, common)
    for k in range(len(LANGUAGES)):
        own = langs == k
        n = min((y[own] == 1).sum(), (y[own] == 0).sum())
        if n:
            out[k] += n / (n + prior) * (threshold_of(logits[own], y[own]) - common)
    return out


def trained(d: np.ndarray, y: np.ndarray, langs: np.ndarray, data: list[np.ndarray], s: Settings) -> Model:
    """A model of labelled rows; data holds the rows of each row's words."""
    order = np.lexsort([[zlib.crc32(x.tobytes()) for x in data], d]) if len(d) else np.zeros(0, int)
    order = order[np.concatenate([[True], d[order][1:] != d[order][:-1]])] if len(order) else order  # repeated rows once
    d, y, langs, data = d[order], y[order], langs[order], [data[i] for i in order]
    share = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        return Model(None, np.zeros(len(LANGUAGES) + 1), share)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in d])
    tune = fold == 1
    if len(set(y[tune].tolist())) < 2 or len(set(y[~tune].tolist())) < 2:
        tune = np.zeros(len(y), bool)
    net = Network(s)
    net.train([x for x, t in zip(data, tune) if not t], y[~tune])
    check = tune if tune.any() else ~tune
    pad = np.zeros((PAD_WORDS + 1, s.width), np.float32)
    logits = np.array([net.logits(net.conv(np.concatenate([net.e[x].sum(1), pad])).max(0)) for x, t in zip(data, check) if t], np.float64)
    return Model(net, thresholds(logits, y[check], langs[check], s.prior), share)


def labelled(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(d, y, text) of the rows that training reads."""
    use = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), "text")
    sizes = texts.select("d", F.octet_length("text").alias("size")).where(F.col("size") <= s.longest).groupBy("d").agg(F.max("size").alias("size"))
    found, order = use.join(sizes, F.col("d") == F.col("doc_id")).select("d", "y", "size"), F.xxhash64("d")
    picked = found.where("y = 1").orderBy(order, "d").limit(s.rows).unionByName(found.where("y = 0").orderBy(order, "d").limit(s.rows))
    sofar = F.sum("size").over(Window.partitionBy("y").orderBy(order, "d"))  # over 2 * s.rows rows
    sample = picked.withColumn("sofar", sofar).where(F.col("sofar") <= s.bytes).select(F.col("d").alias("id_"), "y")
    return texts.join(F.broadcast(sample), (F.col("d") == F.col("id_")) & (F.octet_length("text") <= s.longest)).select("d", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Trains on labelled rows that are not held out, a bounded sample (see above), in one task."""
    small_batches(docs.sparkSession)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(s)
        for batch in batches:
            langs, out = [], []
            for text in batch.column(2).to_pylist():
                tokens = text.lower().split()
                words.ready(len(tokens))
                slots = words.slots(tokens)
                langs.append(language(words.vote[slots])), out.append(words.rows[slots].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(langs, pa.int32()), pa.array(out, pa.binary())], names=["d", "y", "lang", "rows"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        column = lambda k: np.concatenate([np.zeros(0, int), *(b.column(k).to_numpy(zero_copy_only=False) for b in got)]).astype(int)
        data = [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, TABLES) for b in got for x in b.column(3)]
        model = pickle.dumps(trained(column(0), column(1), column(2), data, s), 5)
        got, data = None, None
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    read = labelled(docs, labels, s).mapInArrow(rows_of, "d long, y int, lang int, rows binary")
    got = read.repartition(1).mapInArrow(learn, "model binary").collect()  # the network alone
    trim_driver(docs.sparkSession)
    return pickle.loads(got[0]["model"]) if got else Model(None, np.zeros(len(LANGUAGES) + 1), 0.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted and told_lang; names that clash get a leading underscore."""
    small_batches(docs.sparkSession)
    n_score, n_predicted, n_lang = fresh(docs.columns, "score", "predicted", "told_lang")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = Scorer(model) if model.net is not None else None  # the task's own: a worker that goes on to other work keeps nothing of it
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                if scorer is None:
                    scores, langs = np.full(len(texts), model.share), np.full(len(texts), len(LANGUAGES))
                else:
                    scores, langs = scorer.scores(texts)
                names = [*LANGUAGES, None]
                added = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array([names[i] for i in langs], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, n_score, n_predicted, n_lang])
        model = scorer = None
        give_back()

    schema = T.StructType([*docs.schema.fields, T.StructField(n_score, T.DoubleType()), T.StructField(n_predicted, T.IntegerType()), T.StructField(n_lang, T.StringType())])
    return docs.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "told_lang")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col(scored.columns[-2]) == 0).select(*docs.columns)
