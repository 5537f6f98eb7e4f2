import math

import numpy as np

from claimloom.llm.pseudo import Lexicon, Network, Reader, Settings, cut, lexicon_of, log_likelihoods, op4_pseudo_likelihood, places_of, read_tokens, score, train

PATH = "/root/testdata/sf0.01"
SMALL = Settings(most=16, width=4, rounds=2, batch=64, shard=4000)


def made(rng, own=11, shared=4):
    hashes = np.sort(rng.choice(1 << 32, own, replace=False)).astype(np.uint32)
    return Lexicon(hashes, rng.integers(1, 90, own), rng.integers(0, 50, shared).astype(float), rng.integers(1, 9, shared).astype(float))


def fitted(spark, docs, s):
    rows, names = read_tokens(docs, "text", ["doc_id"], s)
    words = lexicon_of(rows, names[0], s)
    return train(rows, names, s, words), words


def test_counts_are_exact_and_grow(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "A c")], "doc_id long, text string").repartition(3)
    rows, names = read_tokens(docs, "text", ["doc_id"], Settings())
    words = lexicon_of(rows, names[0], Settings())
    leaves = words.ids(Reader().hashes("a b c z"))
    assert len(words.own) == 3 and (leaves[:3] < 3).all() and leaves[3] >= 3 and words.ids(Reader().hashes("A"))[0] == leaves[0]
    net = Network(Settings(), words)
    p = np.exp(net.log_p(np.zeros((4, 4), int), leaves))
    assert abs(p[0] - 3 / 7) < 1e-4 and abs(p[1] - 1 / 7) < 1e-4  # four empty leaves count as half a token each
    assert Settings().own(100) < Settings().own(100_000) < Settings().own(10_000_000) <= Settings().most


def test_the_start_is_the_leaves_share():
    words = made(np.random.default_rng(3))
    net = Network(SMALL, words)
    every = np.arange(words.leaves)
    for place in range(3):
        p = np.exp(net.log_p(np.full((words.leaves, 4), place), every))
        assert abs(p.sum() - 1) < 1e-5


def test_probabilities_add_up_and_match_a_plain_product():
    rng = np.random.default_rng(5)
    words = made(rng)
    net = Network(SMALL, words)
    net.rows[...] = rng.normal(0, 0.7, net.rows.shape)
    places = np.column_stack([rng.integers(0, net.table, 6) + k * net.table for k in range(4)])
    for row in places:
        logs = net.log_p(np.tile(row, (words.leaves, 1)), np.arange(words.leaves))
        assert abs(np.exp(logs).sum() - 1) < 1e-5
        h = np.tanh(net.rows[-1, :-1] + sum(net.rows[r, :-1] for r in row))
        for leaf in range(words.leaves):
            want = 0.0
            for at in range(words.first[leaf], words.first[leaf] + words.long[leaf]):
                own = net.rows[net.node + words.nodes[at]].astype(float)
                z = own[:-1] @ h + own[-1]
                want -= math.log1p(math.exp(-z if words.bits[at] else z))
            assert abs(want - logs[leaf]) < 1e-4


def test_gradients_match_differences():
    rng = np.random.default_rng(6)
    words = made(rng)
    net = Network(SMALL, words)
    net.rows[...] = rng.normal(0, 0.5, net.rows.shape)
    leaves = rng.integers(0, words.leaves, 30)
    places = np.column_stack([rng.integers(0, net.table, 30) + k * net.table for k in range(4)])
    rows, n, sums = net.gradients(places, leaves)
    assert len(set(rows.tolist())) == len(rows) and n[-1] == 30 and n[rows < net.node].sum() == 120
    for i in rng.choice(len(rows), 25, replace=False):
        for d in range(SMALL.width + 1):
            if rows[i] < net.node and d == SMALL.width:
                continue
            old, out = net.rows[rows[i], d], []
            for step in (1e-2, -1e-2):
                net.rows[rows[i], d] = old + step
                out.append(-net.log_p(places, leaves).sum())
            net.rows[rows[i], d] = old
            assert abs((out[0] - out[1]) / 2e-2 - sums[i, d]) < 0.02 + 0.02 * abs(sums[i, d]) or rows[i] == len(net.rows) - 1 and d == SMALL.width


def test_parts_of_a_text_have_the_windows_of_the_whole():
    words = made(np.random.default_rng(7))
    net, x = Network(SMALL, words), np.random.default_rng(8).integers(0, 1 << 32, 700).astype(np.uint32)
    net.rows[...] = np.random.default_rng(9).normal(0, 0.5, net.rows.shape)
    whole, parts = (log_likelihoods(net, [x[:3], x, x[:0], x[5:40]], chunk) for chunk in (100_000, 16))
    assert [len(p) for p in parts] == [3, 700, 0, 35] and all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, parts))
    leaves = words.ids(x)
    places, got = places_of(list(cut(leaves, net.table, 16)), net.table)
    assert (got == leaves).all() and places[0].tolist() == [net.table - 1, 2 * net.table - 1, 2 * net.table + leaves[1], 3 * net.table + leaves[2]]


def test_training_predicts_from_both_sides(spark):
    """A token that its neighbours settle scores above what its frequency gives."""
    docs = spark.createDataFrame([(i, " ".join(["x one y", "p two q"][(i * 7 + k) % 2] for k in range(60))) for i in range(300)], "doc_id long, text string")
    net, _ = fitted(spark, docs.repartition(2), Settings(width=8, batch=64, shard=20_000))
    read = Reader()
    right, wrong = (log_likelihoods(net, [read.hashes(t)])[0][4] for t in ("p two q x one y p two q", "p two q x two y p two q"))
    assert right > -0.3 and wrong < right - 1


def test_context_gains_over_counts_on_the_tables(spark):
    """Mean by token on sf0.1, against the same leaves without training, which is a model of the counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    s = Settings()
    rows, names = read_tokens(docs, "text", ["doc_id"], s)
    words = lexicon_of(rows, names[0], s)
    plain, net = Network(s, words), train(rows, names, s, words)
    some = [np.frombuffer(r[0], np.uint32) for r in rows.select(names[0]).limit(300).collect()]
    before, after = (np.concatenate(log_likelihoods(x, some)).mean() for x in (plain, net))
    assert after > before + 0.4, (before, after)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text")
    one, two = ({r.doc_id: r.log_likelihood for r in score(docs.repartition(n), s=Settings(shard=300_000), keep=["doc_id"]).collect()} for n in (2, 8))
    assert one.keys() == two.keys() and max(abs(one[i] - two[i]) for i in one) < 1e-6


def test_query_and_odd_rows(spark):
    rows = op4_pseudo_likelihood(spark, PATH).toPandas()
    assert len(rows) == 1000 and (rows.log_likelihood < 0).all() and np.allclose(rows.mean_log_likelihood, rows.log_likelihood / rows.n_tokens)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c", "y"), (3, "a b c", "z"), (4, "w " * 30_000, "z"), (None, "b", None)], "doc_id long, text string, N_Tokens string")
    out = score(docs, s=SMALL)
    assert out.columns == ["doc_id", "text", "N_Tokens", "_n_tokens", "log_likelihood", "mean_log_likelihood"]
    got = {(r.doc_id, r.N_Tokens): r for r in out.collect()}
    assert len(got) == 6 and got[1, "x"].log_likelihood == 0 and got[1, "x"].mean_log_likelihood is None and got[2, "x"]["_n_tokens"] == 0
    assert got[3, "y"].log_likelihood == got[3, "z"].log_likelihood and got[4, "z"]["_n_tokens"] == 30_000
    assert score(docs.limit(0), s=SMALL).count() == 0


def test_every_window_is_trained_on(spark):
    """Texts of 7 words, where each place has words of its own: every word moves its row of each position's table where it is a neighbour."""
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(40)], "doc_id long, text string").coalesce(1)
    s = Settings(batch=8, shard=100)
    net, words = fitted(spark, docs, s)
    leaves, start = words.ids(Reader().hashes("a b c d e f g")), Network(s, words)
    moved = np.abs(net.rows - start.rows).max(1) > 1e-6
    for k, o in enumerate((-2, -1, 1, 2)):
        assert moved[leaves + k * net.table].tolist() == [0 <= i - o < 7 for i in range(7)], o
