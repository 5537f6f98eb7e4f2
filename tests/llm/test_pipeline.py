"""Each stage of the pipeline on its predecessor's output, against plain versions of what it decides."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from test_neardup import brute as brute_groups
from test_secrets import brute as brute_secrets

import corpus_pipeline
from claimloom.llm.bpe import default_ranks, read_ranks
from claimloom.llm.toxicity import fit, score

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{PATH}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, PATH).write.parquet(path)
        out.append((name, docs, after := spark.read.parquet(path)))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order_return_documents(steps, spark):
    columns = spark.read.parquet(f"{PATH}/documents.parquet").columns
    assert list(steps) == ["toxicity", "near_dedup", "secrets", "mixing", "bpe"]
    assert all(steps[n][1].columns == columns for n in list(steps)[:-1])


def test_toxicity_drops_what_it_predicts(steps, spark):
    before, after = steps["toxicity"]
    told = score(before, fit(before, spark.read.parquet(f"{PATH}/labels.parquet")))
    assert set(texts(after)) == {r.doc_id for r in told.collect() if r.predicted == 0}


def test_one_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    groups = brute_groups(list(texts(before).items()))
    assert set(texts(after)) == {i for i, (_, c) in groups.items() if i == c}
    assert all(texts(before)[i] == t for i, t in texts(after).items())


def test_secrets_are_blotted_out_and_nothing_else(steps):
    before, after = (texts(x) for x in steps["secrets"])
    assert set(before) == set(after)
    for i, text in before.items():
        assert (after[i] == text) == (not brute_secrets(text)) and not brute_secrets(after[i])


def test_mixing_repeats_whole_documents(steps):
    before, after = steps["mixing"]
    source, size, held = {}, {}, texts(before)
    for r in before.collect():
        source[r.doc_id], size[r.doc_id] = r.source, len(r.text.split())
    copies, got, own = {}, {}, {}
    for r in after.collect():
        assert r.text == held[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        got[r.source] = got.get(r.source, 0) + size[r.doc_id]
    for i, s in source.items():
        own[s] = own.get(s, 0) + size[i]
    assert max(copies.values()) <= 3
    order = sorted(own)
    share = {s: [1, 2, 3][k % 3] for k, s in enumerate(order)}
    target, total = {}, sum(own.values())
    open_ = set(order)
    while open_:
        unit = (total - sum(target.values())) / sum(share[s] for s in open_)
        full = [s for s in open_ if share[s] * unit > 3 * own[s]]
        target |= {s: 3 * own[s] for s in full} if full else {s: share[s] * unit for s in open_}
        open_ -= set(full) if full else open_
    longest = {s: max(size[i] for i in source if source[i] == s) for s in order}
    assert all(abs(got.get(s, 0) - target[s]) <= longest[s] + 16 for s in order)


def test_every_row_is_encoded(steps):
    before, after = steps["bpe"]
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(default_ranks()), special_tokens={})
    held, rows = texts(before), after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert list(r.ids) == oracle.encode_ordinary(held[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(held[r.doc_id].encode()).hexdigest()


def test_defined_cases_pass_through_every_stage(spark, tmp_path):
    """Null texts, ids and sources, empty and blank texts, repeated rows, an empty table and columns of clashing names."""
    rows = [(None, None, None), (None, "a b c d e f", "s"), (1, "", "s"), (2, " \t", None), (3, "one two three four five six", "s"), (3, "one two three four five six", "s"), (4, None, "t"), (5, "password=hunter22x", "t")]
    extra = spark.createDataFrame([(*r, "x", 1.0, 7, "k") for r in rows], "doc_id long, text string, source string, spans string, score double, size int, component_id string")
    for docs in (extra, extra.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, PATH)
            if name != "bpe":
                assert out.columns == docs.columns
            out.write.parquet(path := str(tmp_path / f"{name}-{docs.limit(1).count()}"))
            docs = spark.read.parquet(path)
        if docs.limit(1).count():
            got = [(r.doc_id, r.n_tokens) for r in docs.collect()]
            assert sum(i is None for i, _ in got) >= 2 and {1, 2, 4} <= {i for i, _ in got}
            assert all(n == 0 for i, n in got if i in (1, 4))
        else:
            assert docs.columns[-5:] == ["n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"]


def test_the_pipeline_as_a_whole(spark, steps):
    want = sorted((r.doc_id, r.ids_sha256) for r in steps["bpe"][1].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, PATH).collect()) == want
