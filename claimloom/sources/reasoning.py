"""Model judgements as recorded tables: requests are answered by a join with what was recorded, or by a caller's model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json

#: Fields that may not stand in a model's configuration, at any depth, and the parameters that one may have.
CREDENTIALS = frozenset("api_key apikey authorization openrouter_api_key x_api_key x_openrouter_api_key".split())
PARAMETERS = frozenset("frequency_penalty max_completion_tokens max_retries max_tokens n openrouter_provider plugins presence_penalty reasoning route seed stop temperature timeout top_p".split())
#: What a model is asked with where the caller says nothing.
DEFAULTS = {"max_retries": 0, "timeout": 60_000}
#: Any JSON object.
ANY_OBJECT = {"type": "object", "additionalProperties": True}
INVOCATION = "stage string, request string, output string, failure string, attempts int, history array<string>"


def check_configuration(parameters: dict) -> str:
    """Canonical JSON of a configuration without credentials and unknown parameters."""

    def look(value, path):
        if isinstance(value, dict):
            for k, v in value.items():
                if k.lower().replace("-", "_") in CREDENTIALS:
                    raise ValueError(f"{path}{k} is a credential")
                look(v, f"{path}{k}.")
        elif isinstance(value, list):
            for x in value:
                look(x, path)

    look(parameters, "")
    if unknown := set(parameters) - PARAMETERS:
        raise ValueError(f"{min(unknown)} is not a parameter")
    return json.dumps(parameters, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def settings(parameters: dict) -> dict:
    """What a client is made with: the checked parameters over the defaults. Credentials are the caller's own and stand in no record."""
    check_configuration(parameters)
    return DEFAULTS | parameters


def output_schema(request: str) -> dict:
    """The schema that an input's output_schema asks of its output, else that of any object."""
    found = json.loads(request)
    schema = found.get("output_schema") if isinstance(found, dict) else None
    if schema is not None and not isinstance(schema, dict):
        raise ValueError("output_schema is not a JSON object")
    return schema if schema is not None else ANY_OBJECT


def audit(invocations: DataFrame, path: str, provider: str, model: str, parameters: dict) -> DataFrame:
    """Stores an audit record of each row of run: stage, configuration, input, output and every attempt; gives their references."""
    from . import artefacts

    known = json.dumps({"model": model, "parameters": json.loads(check_configuration(parameters)), "provider": provider})[1:-1]
    body = F.concat(
        F.lit("{" + known + ',"stage":'), F.to_json(F.array("stage")).substr(F.lit(2), F.length(F.to_json(F.array("stage"))) - 2), F.lit(',"structured_input":'), F.col("request"),
        F.lit(',"structured_output":'), F.coalesce("output", F.lit("null")), F.lit(',"retry_history":['), F.array_join("history", ","), F.lit("]}"),
    )
    return artefacts.write(invocations.select(body.alias("payload")), path, "reasoning-invocation")


def request_key(stage: str, payload: str):
    return F.sha2(F.concat(F.lit(stage), F.lit("\n"), canonical_json(F.col(payload))), 256)


def replay(requests: DataFrame, recorded: DataFrame, stage: str, payload: str = "payload") -> DataFrame:
    """requests with output: what was recorded for the same stage and canonical input, null if nothing was. The first record of an input holds."""
    first = recorded.where(F.col("stage") == stage).groupBy(request_key(stage, "structured_input").alias("key")).agg(F.min_by("structured_output", "sequence").alias("output"))
    return requests.withColumn("key", request_key(stage, payload)).join(first, "key", "left").drop("key")


def retry_outcome(attempts: DataFrame, by: str, failed: str, most: int) -> DataFrame:
    """For each request: "invocation" if all its most attempts were the provider's failures, "validation" if its attempts ran out otherwise, else "completed". failed is provider, invalid or null."""
    n = attempts.groupBy(by).agg(F.count_if(F.col(failed) == "provider").alias("p"), F.count_if(F.col(failed).isNotNull()).alias("f"), F.count("*").alias("n"))
    outcome = F.when(F.col("p") >= most, "invocation").when(F.col("f") >= most, "validation").otherwise("completed")
    return n.select(by, outcome.alias("outcome"))


def run(requests: DataFrame, stage: str, model: Callable[[str], str], validate: Callable[[dict], None], most: int, payload: str = "payload") -> DataFrame:
    """Asks the model for each request, at most so often; every attempt is kept in history."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for request in batch[payload]:
                history, output, kinds = [], None, []
                for attempt in range(1, most + 1):
                    try:
                        answer = model(request)
                    except Exception as error:
                        kinds.append("provider")
                        history.append(json.dumps({"attempt": attempt, "provider": str(error)}))
                        continue
                    try:
                        found = json.loads(answer)
                        if not isinstance(found, dict):
                            raise ValueError("the output is not an object")
                        validate(found)
                        output = answer
                        history.append(json.dumps({"attempt": attempt, "output": found}))
                        break
                    except ValueError as error:
                        kinds.append("invalid")
                        history.append(json.dumps({"attempt": attempt, "invalid": str(error)}))
                failure = None if output is not None else "invocation" if set(kinds) == {"provider"} else "validation"
                out.append((stage, request, output, failure, len(history), history))
            yield pd.DataFrame(out, columns=["stage", "request", "output", "failure", "attempts", "history"])

    return requests.select(payload).mapInPandas(ask, INVOCATION)


def extract_once(sources: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Each source version not in done, once."""
    return sources.join(done.select(F.col(version).alias("done_")).distinct(), F.col(version) == F.col("done_"), "left_anti").dropDuplicates([version])
