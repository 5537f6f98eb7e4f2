"""Requests are canonical as they are made, and Python works on a text once in a stage."""

import hashlib
import json

from pyspark.sql import functions as F

from claimloom.operators import requests
from claimloom.plans.catalog import QUERIES


def dumped(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def named(text):
    return "sha256:" + hashlib.sha256(f'{{"payload":{text},"schema_version":"1"}}'.encode()).hexdigest()


def test_requests_are_canonical(spark):
    rows = spark.createDataFrame([(1, True, 'é"\\\n\x01/', 1e20), (-(2**63), False, "", 0.5), (None, None, None, None)], "n long, Yes boolean, t string, d double")
    for fields in (("n",), ("n", "Yes"), ("t", "n"), ("d", "Yes")):
        made = requests.create(rows, "claim-decision", *fields)
        made = made.withColumn("same_", requests.identity(F.col("request"))).withColumn("output", F.concat(F.lit('{"b": 1.0, "a": '), F.col("payload"), F.lit("}")))
        recorded = made.select(F.lit("claim-decision").alias("stage"), F.col("payload").alias("structured_input"), F.col("output").alias("structured_output"), F.lit(0).alias("sequence"))
        for r in requests.resolve(made.drop("output"), recorded, "claim-decision").collect():
            payload = {f: r[f] for f in fields}
            assert r.payload == dumped(payload) and r.request == dumped({"stage": "claim-decision", "input": payload})
            assert r.request_id == r.same_ == named(r.request)
            assert r.result == dumped({"output": {"a": payload, "b": 1.0}, "request": r.request_id}) and r.result_id == named(r.result)


def test_no_python_step_over_another(spark):
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    rows = spark.createDataFrame([(1, "x")], "n long, t string")
    assert steps(requests.create(rows, "claim-decision", "n")) == 0 and steps(requests.create(rows, "claim-decision", "n", "t")) == 1
    assert steps(QUERIES["request_replay"](spark, "/root/testdata/sf0.001")) == 2  # of results before they are grouped, of requests after they are joined
