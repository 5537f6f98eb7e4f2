import duckdb
import numpy as np
from pyspark.sql import functions as F

from claimloom.llm.ann import nearest, op8_ann
from claimloom.llm.topk import SQL, block_search, op9_topk, top_k

PATH = "/root/testdata/sf0.01"
ODD = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (50, [-3.0, -2.0])]


def test_recall_and_scores_against_brute_force(spark):
    rows = spark.read.parquet(f"{PATH}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    hit = total = 0
    got = op8_ann(spark, PATH).toPandas()
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and q not in own.vec_id.tolist()
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id]) and own.score.is_monotonic_increasing
        hit += len(set(own.vec_id) & set(ids[np.lexsort([ids, d])[:10]]))
        total += 10
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("rank", F.lit(1))
    got = nearest(rows, F.col("id") % 100 == 0, probe=1.0).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [8, 9, 100, 50]
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == [0, 8, 9, 50]
    exact = top_k(rows, F.col("id") % 50 == 0).toPandas()
    assert exact[exact.query_id == 0].sort_values("rank").vec_id.tolist() == [8, 9, 4, 100, 50]
    assert nearest(rows.limit(0), F.col("id") == 0).count() == top_k(rows.limit(0), F.col("id") == 0).count() == 0


def test_exact_search_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{PATH}/embeddings.parquet'")
    want = sorted(con.sql(SQL).fetchall())
    assert sorted(map(tuple, op9_topk(spark, PATH).select("query_id", "rank", "vec_id", "score").collect())) == want


def test_block_search_with_ties_and_negative_weights():
    rng = np.random.default_rng(2)
    ids, x, q = np.arange(700), rng.integers(-3, 4, (700, 6)).astype(float), rng.integers(-3, 4, (40, 6)).astype(float)
    place, name, score = block_search(ids, x, np.arange(40), q, 5)
    for i in range(40):
        s = x @ q[i]
        s[i] = -1e9
        assert name[place == i].tolist() == np.lexsort([ids, -s])[:5].tolist()


def test_repeated_ids_with_several_vectors(spark):
    """One candidate an id, at its nearest; a query asks with the least of its vectors, whatever the order of rows."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40) for _ in range(1 + 12 * (i in (0, 3)))]
    lists = None
    for n in (1, 3):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n)
        got = nearest(df, F.col("id") == 0, probe=1.0).orderBy("rank").collect()
        exact = top_k(df, F.col("id") == 0).orderBy("rank").collect()
        found = [tuple(r) for r in got], [tuple(r) for r in exact]
        assert lists is None or found == lists
        lists = found
    q = np.array(min(v for i, v in rows if i == 0))
    best = {}
    for i, v in rows:
        if i:
            best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(v) - q) ** 2).sum())))
    assert [r[2] for r in lists[0]] == sorted(best, key=lambda i: (best[i], i))[:10]
    assert nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, probe=0.01).count() == 10
