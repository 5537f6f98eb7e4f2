import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import components as components_of
from claimloom.llm import neardup
from claimloom.llm.components import components
from claimloom.llm.neardup import near_duplicates, neardup_stage, op3_neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing every pair of sets through an index of shingles."""
    sets = []
    for i, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = {}
    for k, (i, s) in enumerate(sets):
        seen = {}
        for x in s:
            for j in index.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            index[x].append(k)
        for j, both in seen.items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = top(i), top(sets[j][0])
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets}


def check(got, rows):
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_whole_table_matches_brute_force(spark):
    path = "/root/testdata/sf0.01"
    check(op3_neardup(spark, path).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()])


def test_families_of_edited_copies(spark, monkeypatch):
    """A dense family, whose regions are dealt out as several blocks, and short, empty and repeated texts."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=90)
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, " ".join(base)), (7, " ".join(base))]
    for i in range(10, 160):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")).withColumn("sig", F.lit(1))
    check(near_duplicates(docs).collect(), rows)
    kept = {r.doc_id for r in neardup_stage(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in brute(rows).items() if i == c}


def family(rng, words, base, first, n, edits):
    out = []
    for i in range(first, first + n):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i, " ".join(text)))
    return out


def test_a_family_of_thousands_over_many_partitions(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = family(rng, words, rng.choices(words, k=200), 0, 2500, 12) + [(i, " ".join(rng.choices(words, k=60))) for i in range(5000, 5400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(50)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_links_come_from_the_forest(spark, monkeypatch):
    """What the ascent adds after the forest's candidates is a small rest, and nothing is linked without them."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(2000)]
    rows = [r for k in range(40) for r in family(rng, words, rng.choices(words, k=80), 100 * k, 1 + k, 6)]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string"), []
    plain = neardup.ascent

    def watched(docs, regions, pairs, found, width):
        out = plain(docs, regions, pairs, found, width)
        seen.append((found.where("node <> component").count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "ascent", watched)
    check(near_duplicates(docs).collect(), rows)
    (merged, extra) = seen[0]
    assert merged > 250 and extra <= 0.02 * merged


def test_candidates_have_the_longest_prefixes():
    """Against every pair's prefix: what each row keeps is never shorter than what it passes over nearby."""
    nrng = np.random.default_rng(3)
    key = np.sort(nrng.integers(0, 4, 120))
    rest = nrng.integers(0, 3, (120, neardup.SORTED)).astype(np.uint16)
    order = np.lexsort([*rest.T[::-1], key])
    key, rest = key[order], rest[order]
    prefix = lambda a, b: 0 if key[a] != key[b] else neardup.DEPTH + int(np.cumprod(rest[a] == rest[b]).sum())
    assert [prefix(i - 1, i) for i in range(1, 120)] == neardup.longest_prefixes(key, rest)[1:].tolist()
    i, j = neardup.by_longest_prefix(key, rest)
    got = set(zip(i.tolist(), j.tolist()))
    for x in range(120):
        near = [y for y in range(max(0, x - neardup.NEAR), min(120, x + neardup.NEAR + 1)) if y != x]
        best = sorted((prefix(x, y) for y in near), reverse=True)[: neardup.NEAR]
        kept = sorted((prefix(x, y) for y in near if (min(x, y), max(x, y)) in got), reverse=True)
        assert [p for p in best if p] == kept[: sum(p > 0 for p in best)]
    assert all(key[a] == key[b] for a, b in got)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = rng.choices([f"w{i}" for i in range(9000)], k=120_000)
    other = list(long)
    other[::40] = ["x"] * len(other[::40])
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(other)), (4, " ".join(long[:60_000]))]
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_null_ids_stay_and_empty_tables_pass(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (3, 3, True), (3, 3, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bundle", [1_000_000, 40])
def test_components_of_long_chains(spark, monkeypatch, bundle):
    """In one bundle, and in several that the star steps join."""
    plain = components_of.contracted

    def contracted(batches):
        components_of.BUNDLE = bundle
        return plain(batches)

    monkeypatch.setattr(components_of, "BUNDLE", bundle)
    monkeypatch.setattr(components_of, "contracted", contracted)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    random.Random(4).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 5000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
