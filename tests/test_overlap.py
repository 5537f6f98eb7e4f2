"""interval_overlap over all pairs, against brute force."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import claims, temporal
from claimloom.plans.catalog import QUERIES


def brute(events):
    def span(e):
        low, k = e[2].date(), e[0] % 4
        return (low if k != 1 else None, low + timedelta(days=int(e[3] // 1 % 5)) if k != 2 else None, k in (2, 3))

    def starts_in_time(x, y):
        return x[0] is None or y[1] is None or x[0] < y[1] or (x[0] == y[1] and y[2])

    spans = [(e[0], e[1], span(e)) for e in events]
    return sorted((i, j) for i, u, x in spans for j, v, y in spans if u == v and i < j and starts_in_time(x, y) and starts_in_time(y, x))


def test_every_overlapping_pair_of_a_user(spark, tmp_path):
    start = datetime(2024, 2, 27, 22, 30)
    events = [(i, i % 3, start + timedelta(hours=17 * (i * 7 % 23)), (i * 13 % 50) / 7) for i in range(1, 61)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["interval_overlap"](spark, str(tmp_path)).collect()))
    want = brute(events)
    assert got == want and len({a % 10 for a, _ in want}) == 10 and len(want) < 3 * 20 * 19 // 2


def test_bounds_are_read_once_for_each_row_and_not_for_each_pair(spark, tmp_path):
    start = datetime(2024, 2, 27)
    spark.createDataFrame([(i, 1, start, 1.0) for i in range(4)], "event_id long, user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    claim = spark.createDataFrame([(k, "s", "p", k, "literal") for k in "ab"], "claim_id string, subject string, predicate string, object string, object_kind string")
    claim = claim.withColumn("time", temporal.during(F.lit("2024-01-01"), F.col("claim_id")))
    for joined in (QUERIES["interval_overlap"](spark, str(tmp_path)), claims.conflicts(claim, claim)):
        joins = [x for x in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
        assert len(joins) == 1 and not any(x in joins[0].lower() for x in ("rlike", "regexp", "cast(")), joins
