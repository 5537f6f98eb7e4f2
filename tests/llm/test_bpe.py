import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.llm.bpe import Codec, bpe_stage, decode, default_ranks, encode, op2_bpe, read_ranks

RANKS = read_ranks(default_ranks())
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(RANKS)
ODD = [
    "", " ", "  ", "a", "it's", "'s's", "''s", " 's", "\n's", "'re 've 'll 'r 'v 'l", "'rx 'ree 'lll", "don't  stop", "x \n y", "tail  \n", "a b", "　x", "12 34ab", "!!'s", "'",
    "a'", "a''ll", "1'm", "é'D 'd", "𝄞𝄞 x", "a\x00b\x00", "\x1c\x1d x", "²³ ½", "<|endoftext|>", "ab" * 300, " " * 500 + "x", "a" * 700, "\r\n\r\n a\t\tb", "'t'", "'ll'll've",
]


def test_encodes_as_the_library_does():
    assert [x.tolist() for x in CODEC.encode_batch(ODD)] == [ORACLE.encode_ordinary(t) for t in ODD]
    rng = random.Random(5)
    texts = ["".join(rng.choices("'stmdrevl aLé1²!.\n\t  ", k=rng.randrange(60))) for _ in range(4000)]
    assert [x.tolist() for x in CODEC.encode_batch(texts)] == [ORACLE.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text_round_trips(texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    for t, ids in zip(texts, CODEC.encode_batch(texts)):
        assert CODEC.decode(ids.tolist()) == t.encode()


def test_long_pieces_merge_as_short_ones_do():
    rng = random.Random(7)
    for _ in range(50):
        piece = "".join(rng.choices("abeiou", k=rng.randrange(2, 120))).encode()
        assert CODEC._merged_long(piece) == ORACLE._encode_single_piece(piece) if piece not in RANKS else True
        assert CODEC.merged(piece) == ORACLE._encode_single_piece(piece)


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op2_bpe(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ORACLE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_frames_with_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", None), (4, "", "y")], "doc_id long, text string, IDS string")
    out = encode(docs, default_ranks())
    assert out.columns == ["doc_id", "text", "IDS", "n_tokens", "_ids", "ends"]
    back = decode(out, default_ranks(), ids="_ids").collect()
    assert sorted((r.n_tokens, bytes(r.decoded)) for r in back) == [(0, b""), (0, b""), (0, b""), (2, b"a b")]
    assert [r.ends for r in back if r.text == "a b"] == [[1, 3]]
    assert encode(docs.limit(0), default_ranks()).count() == 0
    stage = bpe_stage(spark, docs.withColumnRenamed("IDS", "lang"), "")
    assert stage.count() == 4 and stage.where(F.col("n_tokens") == 2).count() == 1


@pytest.mark.parametrize("lead", ["a", "1", "!"])
def test_classes_of_all_code_points(lead):
    """A code point that the library joins to lead is in lead's class here."""
    ranks = {bytes([i]): i for i in range(256)} | {lead.encode() + bytes([i]): 256 + i for i in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, wrong = Codec(ranks), []
    points = [lead + chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(points, own.encode_batch(points)):
        if ids.tolist() != probe.encode_ordinary(text):
            wrong.append(text)
    assert not wrong, (len(wrong), [hex(ord(x[1])) for x in wrong[:40]])


def test_kept_ends_decode_any_span():
    rng = random.Random(11)
    for text in ["", "é𝄞 don't  stop", "ab" * 300 + " 12²½ \n\n x"]:
        whole, ids = text.encode(), CODEC.encode_batch([text])[0]
        ends = CODEC.sizes[ids].cumsum().tolist()
        assert (ends[-1] if ends else 0) == len(whole)
        for _ in range(60):
            low, high = sorted(rng.choices(range(len(whole) + 1), k=2))
            assert CODEC.decode_span(ids.tolist(), ends, low, high) == whole[low:high]


def test_a_text_longer_than_a_chunk():
    rng = random.Random(3)
    text = " ".join(rng.choices(["word", "don't", "12345", "é!?", "\n\n", "x" * 90], k=200_000))
    assert len(text) > 1_000_000
    (ids,) = CODEC.encode_batch([text])
    assert ids.tolist() == ORACLE.encode_ordinary(text) and CODEC.decode(ids.tolist()) == text.encode()
