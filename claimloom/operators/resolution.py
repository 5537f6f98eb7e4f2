"""Resolving time expressions and mentions: what can be computed is, the rest is answered by recorded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.reasoning import replay
from . import temporal

MOST_CONTEXT = 8


def resolve_times(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests (expression, reference, payload) with constraint, kind and methodology: the calendar first, recorded outputs of stage temporal-resolution for what it leaves, else unresolved."""
    own = requests.withColumn("calendar_", temporal.resolve_calendar(F.col("expression"), F.col("reference")))
    done = own.where("calendar_ is not null").withColumn("output", F.lit(None).cast("string"))
    asked = replay(own.where("calendar_ is null"), recorded, "temporal-resolution")  # only what is left reaches the join
    both = done.unionByName(asked)
    judged = F.from_json(F.get_json_object("output", "$.constraint"), temporal.DDL)
    out = both.withColumn("constraint", F.coalesce("calendar_", judged))
    method = F.when(F.col("calendar_").isNotNull(), "calendar").when(F.col("constraint").isNotNull(), "recorded")
    return out.withColumn("kind", F.when(F.col("constraint").isNull(), "unresolved").otherwise("resolved")).withColumn("methodology", F.coalesce(method, F.lit("none"))).drop("calendar_", "output")


def context_error(context: Column) -> Column:
    """First fault of a bounded context, an array of structs (evidence, constraint): too many, or one of the two without the other."""
    halves = F.exists(context, lambda c: (F.coalesce(F.size(c["evidence"]), F.lit(0)) > 0) != c["constraint"].isNotNull())
    return F.when(F.size(context) > MOST_CONTEXT, "size").when(halves, "halves")


def citation_error(context: Column, cited: Column, chosen: Column) -> Column:
    """A judged constraint must rest on evidence of one record with the same constraint, and no record's constraint may be strictly stronger."""
    same = lambda c: c["constraint"].eqNullSafe(chosen) & (F.size(F.array_except(cited, c["evidence"])) == 0)
    rests = (F.size(cited) > 0) & F.exists(context, same)
    stronger = F.exists(context, lambda c: temporal.strictly_stronger(c["constraint"], chosen))
    return F.when(~rests, "evidence").when(stronger, "stronger")


def resolve_entities(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests (mention, candidates, payload) with kind, entity_id and error: recorded outputs of stage entity-resolution, held to the candidates."""
    from .history import outcome_error

    out = replay(requests, recorded, "entity-resolution")
    kind, entity = F.get_json_object("output", "$.kind"), F.get_json_object("output", "$.entity_id")
    out = out.withColumn("kind", F.coalesce(kind, F.lit("unresolved"))).withColumn("entity_id", entity).drop("output")
    return out.withColumn("error", outcome_error(F.col("kind"), F.col("entity_id"), F.col("candidates")))
