r"""Byte-level BPE encoding and decoding, pre-tokenised without regular expressions over texts.

Texts of a batch stand one after another as an array of code points, an end mark after each.
A table gives every code point its class, every class is a transition function of a small
automaton, and functions compose: their closure under composition is a finite monoid whose
elements are bytes. An associative scan over these bytes (within blocks, over the blocks'
totals, then the carry put in) gives the state after every character, and from states and
neighbouring classes follow the places where a match of the pattern starts. The slices
between them go to a cache of merged pieces; only a miss runs the pair merging.

``encode`` adds, for each document, the ids and for each id the end of its bytes within the
UTF-8 text; ``decode`` turns ids into bytes again. Vocabulary and pattern are parameters of
the caller's files: the rank file is read on the driver from its path and broadcast.

Defined cases: null and empty texts have no ids; white space of any kind and repeated rows are
ordinary; special tokens' strings are ordinary text; an empty table gives an empty table;
other columns pass through, added names that clash get a leading underscore.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, give_back, small_batches, table

#: Unicode's White_Space.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and digits that Unicode assigned after version 16, which the encoding library goes by.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
END, LETTER, DIGIT, OTHER, SPACE, BLANK, QUOTE, SHORT, E, RV, EL = range(11)
# states: what the character before was part of
BEGIN, IN_LETTERS, IN_DIGITS, IN_OTHER, AT_SPACE, AT_BLANK, AT_QUOTE, AT_RV, AT_EL, CLIPPED = range(10)
STATES = 10
#: Characters worked on at once, and pieces that one generation of the cache holds.
CHUNK, CACHE = 500_000, 120_000


def _functions() -> np.ndarray:
    """For each class, the state that follows each state."""
    f = np.empty((11, STATES), np.uint8)
    for kind, state in ((END, BEGIN), (DIGIT, IN_DIGITS), (OTHER, IN_OTHER), (SPACE, AT_SPACE), (BLANK, AT_BLANK)):
        f[kind] = state
    f[[LETTER, SHORT, E, RV, EL]] = IN_LETTERS
    f[SHORT, AT_QUOTE] = CLIPPED
    f[E, AT_RV] = CLIPPED
    f[RV, AT_QUOTE] = AT_RV
    f[EL, AT_QUOTE] = AT_EL
    f[EL, AT_EL] = CLIPPED
    f[QUOTE] = AT_QUOTE  # it starts a match, so that 's and the like can follow
    f[QUOTE, [IN_OTHER, AT_SPACE, AT_QUOTE]] = IN_OTHER
    return f


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, element of each class, products of elements (first, then second), element applied to state. Element 0 is the identity."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, range(0x110000)))
    for category, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):  # its tables are newer than unicodedata's
        for run in regex.finditer(category, points):
            kinds[run.start() : run.end()] = kind
    for low, high in LATER:
        kinds[low : high + 1] = OTHER
    kinds[list(WHITE)] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = QUOTE
    for letters, kind in (("stmd", SHORT), ("e", E), ("rv", RV), ("l", EL)):
        kinds[[ord(x) for x in letters]] = kind
    f = _functions()
    elements = [tuple(range(STATES))]
    known = {elements[0]: 0}
    for e in map(tuple, f.tolist()):
        if e not in known:
            known[e] = len(elements)
            elements.append(e)
    while True:
        size = len(elements)
        for a in list(elements):
            for b in list(elements):
                e = tuple(b[x] for x in a)
                if e not in known:
                    known[e] = len(elements)
                    elements.append(e)
        if len(elements) == size:
            break
    product = np.array([[known[tuple(b[x] for x in a)] for b in elements] for a in elements], np.uint8)
    return kinds, np.array([known[tuple(e)] for e in f.tolist()], np.uint8), product, np.array(elements, np.uint8)


def scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """The state after each element, from BEGIN."""
    _, _, product, applied = automaton()
    m, flat = len(product), product.ravel()

    def prefix(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within blocks of width, by column; and the product of all blocks before each."""
        rows = -(-len(x) // width)
        block = np.zeros(rows * width, np.uint8)
        block[: len(x)] = x
        block = np.ascontiguousarray(block.reshape(rows, width).T)
        for j in range(1, width):
            block[j] = flat[block[j - 1].astype(np.uint16) * m + block[j]]
        if rows == 1:
            return block, np.zeros(1, np.uint8)
        inner, before = prefix(block[-1])
        totals = flat[before.astype(np.uint16)[None, :] * m + inner].T.ravel()[:rows]
        return block, np.concatenate([np.zeros(1, np.uint8), totals[:-1]])

    block, before = prefix(elements)
    carry = applied[before, BEGIN]
    return applied.ravel()[block.astype(np.uint16) * STATES + carry[None, :]].T.ravel()[: len(elements)]


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a match starts at each character; kinds end with END, and an END starts too."""
    _, element, _, _ = automaton()
    state = scan(element[kinds])
    last = np.concatenate([np.array([BEGIN], np.uint8), state[:-1]])
    after = np.concatenate([state[1:], np.array([BEGIN], np.uint8)])
    next_kind = np.concatenate([kinds[1:], np.array([END], np.uint8)])
    joins = np.zeros((STATES, STATES), bool)  # state before, state here: no match starts here
    joins[[IN_LETTERS, AT_SPACE, AT_RV, AT_EL], IN_LETTERS] = True
    joins[:, CLIPPED] = True
    joins[[IN_DIGITS, AT_SPACE], IN_DIGITS] = True
    joins[[IN_OTHER, AT_SPACE, AT_QUOTE], IN_OTHER] = True
    out = ~joins.ravel()[last * np.uint8(STATES) + state]
    blank = (state == AT_SPACE) | (state == AT_BLANK)
    was_blank = (last == AT_SPACE) | (last == AT_BLANK)
    ends_run = (next_kind != SPACE) & (next_kind != BLANK) & (next_kind != END)
    out[blank] = (~was_blank | ends_run)[blank]
    half = (state == AT_RV) | (state == AT_EL)
    out[half] = after[half] != CLIPPED
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encodes and decodes by a table of ranks; pieces once merged stay in a two-generation cache."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.young, self.old = ranks, {}, {}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 128:
            return self._merged_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.bytes_of)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same with a heap, for pieces whose length squared would tell."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0: none does
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the parts has changed
            end[i], end[mid] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := prev[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as bytes of int32."""
        found = list(map(self.young.get, pieces))
        if None in found:
            young, old = self.young, self.old
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    ids = young.get(piece)
                    if ids is None:
                        ids = old.get(piece)
                        if ids is None:
                            ids = np.array(self.merged(piece.encode("utf-8")), np.int32).tobytes()
                        if len(piece) <= 64:
                            young[piece] = ids
                    found[i] = ids
            if len(young) > CACHE:
                self.young, self.old = {}, young
        return found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        out: list[np.ndarray] = []
        kinds_of = automaton()[0]
        i = 0
        while i < len(texts):
            n, j = 0, i
            while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                n += len(texts[j]) + 1
                j += 1
            text = "\0".join(texts[i:j]) + "\0"
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
            kinds = kinds_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
            kinds[ends] = END
            at = np.flatnonzero(starts(kinds))
            cuts = np.searchsorted(at, ends).tolist()
            at = at.tolist()
            pieces = [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]
            low = 0
            del kinds
            for high in cuts:
                out.append(np.frombuffer(b"".join(self._encoded(pieces[low:high])), np.int32))
                low = high + 1  # past the end mark
            i = j
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_span(self, ids: list[int], ends: list[int], low: int, high: int) -> bytes:
        """Bytes low to high of the text, from the ids that hold them alone: the kept ends tell which."""
        a, b = bisect_right(ends, low), bisect_left(ends, high) + 1
        start = ends[a - 1] if a else 0
        return self.decode(ids[a:b])[low - start : high - start] if low < high else b""


ADDED = {
    "n_tokens": T.LongType(), "n_bytes": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, ranks_path: str, text: str = "text", add: tuple[str, ...] = ("n_tokens", "ids", "ends"), keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with what add names of: n_tokens, n_bytes (where the last id's bytes end), ids, ends (of each id's bytes), ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that the ids give when decoded)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    keep = docs.columns if keep is None else keep
    kept = docs.select(*keep)
    names = fresh(keep, *add)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, ADDED[a]) for n, a in zip(names, add))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)  # the task's own: a worker that goes on to other work keeps nothing of it
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                ids = codec.encode_batch(texts)
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                lists = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                if "ids_sha256" in add or "decoded_sha256" in add:
                    plain = [x.tolist() for x in ids]
                for a in add:
                    if a == "n_tokens":
                        columns.append(pa.array([len(x) for x in ids], pa.int64()))
                    elif a == "n_bytes":
                        columns.append(pa.array([int(codec.sizes[x].sum()) for x in ids], pa.int64()))
                    elif a == "ids":
                        columns.append(pa.ListArray.from_arrays(lists, pa.array(np.concatenate(ids), pa.int32())))
                    elif a == "ends":
                        columns.append(pa.ListArray.from_arrays(lists, pa.array(np.concatenate([np.cumsum(codec.sizes[x]) for x in ids]), pa.int32())))
                    elif a == "ids_sha256":
                        columns.append(pa.array([hashlib.sha256(",".join(map(codec.names.__getitem__, x)).encode()).hexdigest() for x in plain]))
                    else:
                        columns.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in plain]))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])
        codec = None
        give_back()

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded, the bytes of its ids; null for null. An id out of the table fails."""
    small_batches(tokens.sparkSession)
    held = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    (name,) = fresh(tokens.columns, "decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else codec.decode(x) for x in lists], pa.binary())], schema=None, names=[*batch.schema.names, name])

    return tokens.mapInArrow(run, schema)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, default_ranks(), add=("n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"), keep=["doc_id"])


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, the ends of their bytes and its digests beside them."""
    return encode(docs, default_ranks(), add=("n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"), keep=[c for c in docs.columns if c != "text"])
