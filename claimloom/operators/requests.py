"""Durable requests and results: a request names its stage and input by content, a result is bound to its request, a replay is held to both.

Records are JSON texts in canonical form; an identity is the hash of a record's envelope in the artefact store."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json, canonical_struct, exact_keys
from ..sources import artefacts, reasoning

#: The fields of a completed result, by the stage that it completes.
COMPLETED = {
    "entity-resolution": ("history", "reasoning_invocation", "request"),
    "temporal-resolution": ("outcome", "reasoning_invocation", "request"),
}


def identity(record: Column, canonical: bool = False) -> Column:
    """canonical: record is canonical JSON already. Each canonical_json over another one holds one more Python worker in every running task."""
    return F.concat(F.lit("sha256:"), F.sha2((artefacts.sealed if canonical else artefacts.envelope)(record), 256))


def create(rows: DataFrame, stage: str, *fields: str) -> DataFrame:
    """rows with payload (the canonical input made of fields), request and request_id."""
    out = rows.withColumn("payload", canonical_struct(rows, *fields))
    out = out.withColumn("request", F.concat(F.lit('{"input":'), F.col("payload"), F.lit(f',"stage":{json.dumps(stage, ensure_ascii=False)}}}')))
    return out.withColumn("request_id", identity(F.col("request"), canonical=True))


def resolve(requests: DataFrame, recorded: DataFrame, stage: str) -> DataFrame:
    """requests with output (what was recorded for exactly their input, null if nothing was), result and result_id."""
    out = reasoning.replay(requests, recorded, stage)
    body = F.concat(F.lit('{"output":'), F.coalesce("output", F.lit("null")), F.lit(',"request":"'), F.col("request_id"), F.lit('"}'))
    out = out.withColumn("result", canonical_json(body))
    return out.withColumn("result_id", identity(F.col("result"), canonical=True))


def replay(requests: DataFrame, results: DataFrame) -> DataFrame:
    """requests with output of their results (result, result_id) and diagnostic: "missing", "request" where the request's bytes are not those that its id names,
    "identity" where a result's are not, "repeated" where several results differ. A result counts only for the request that it names."""
    named = results.select(F.get_json_object("result", "$.request").alias("for_"), "result", "result_id")
    each = named.groupBy("for_").agg(F.min("result").alias("one_"), F.count_distinct("result").alias("n_"), F.bool_and(F.col("result_id").eqNullSafe(identity(F.col("result")))).alias("sound_"))
    joined = requests.join(each, F.col("request_id") == F.col("for_"), "left")
    rules = (
        (~F.col("request_id").eqNullSafe(identity(F.col("request"))), "request"), (F.col("for_").isNull(), "missing"), (~F.col("sound_"), "identity"), (F.col("n_") > 1, "repeated"),
    )
    joined = joined.withColumn("diagnostic", F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    output = F.when(F.col("diagnostic").isNull(), F.get_json_object("one_", "$.output"))
    return joined.withColumn("output", output).drop("for_", "one_", "n_", "sound_")


def completed_error(record: Column, stage: str) -> Column:
    """"shape" where a record is not a completed result of stage."""
    return F.when(~exact_keys(record, *COMPLETED[stage]), "shape")
