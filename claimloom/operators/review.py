"""Ontology review: four roles in a fixed order, each answered from what was recorded for exactly its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..sources.reasoning import replay
from .records import ROLES, parsed, shape_error


def gaps(mappings: DataFrame) -> DataFrame:
    """Mappings that a review may be asked about."""
    return mappings.where("disposition = 'ontology_gap'")


def run(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests (review_id, payload) with each role's output, failed (the first role without a sound output) and complete.

    A role's input is the request with all outputs before it; a role after a failed one is not asked."""
    out = requests.withColumn("payload_", canonical_json(F.col("payload"))).withColumn("failed", F.lit(None).cast("string"))
    keep = list(requests.columns)
    for role, shape in ROLES.items():
        asked = replay(out, recorded, role, "payload_").withColumnRenamed("output", role)
        fault = F.when(F.col(role).isNull(), "output").otherwise(shape_error(shape)(F.col(role)))
        out = asked.withColumn("failed", F.coalesce("failed", F.when(fault.isNotNull(), F.lit(role))))
        out = out.withColumn("payload_", F.when(F.col("failed").isNull(), canonical_json(F.concat(F.lit('{"before":'), F.col("payload_"), F.lit(f',"{role}":'), F.col(role), F.lit("}")))))
        keep.append(role)
    return out.select(*keep, "failed", F.col("failed").isNull().alias("complete"))


def vendored(reviews: DataFrame, store: DataFrame) -> DataFrame:
    """(review_id, vendored) of reviews (review_id, position, identity): the stored external artefacts that later roles may read, a JSON list in the order of position."""
    held = store.where("kind = 'external-ontology'").select(F.col("identity"), "payload").dropDuplicates(["identity"])
    reference = F.to_json(F.struct("identity", F.lit("external-ontology").alias("kind"), F.lit("1").alias("schema_version")))
    each = F.concat(F.lit('{"artefact":'), reference, F.lit(',"content":'), F.col("payload"), F.lit("}"))
    rows = reviews.join(held, "identity").groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("position", each.alias("x")))).alias("xs"))
    return rows.select("review_id", canonical_json(F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))).alias("vendored"))


def assessments(reviews: DataFrame, artefacts: DataFrame) -> DataFrame:
    """(review_id, term, suitable, rationale, identity) of the proposer's assessments; those whose index names none of the review's artefacts (review_id, artefact_index, identity) have a null identity."""
    rows = reviews.select("review_id", F.inline(parsed(F.col("proposer"), ROLES["proposer"])["assessments"]))
    return rows.join(artefacts, ["review_id", "artefact_index"], "left").select("review_id", "term", "suitable", "rationale", "identity")


def proposal(reviews: DataFrame) -> DataFrame:
    """The synthesis of complete reviews: changes, the reconsidered mapping, texts of the release."""
    return reviews.where("complete").select("review_id", parsed(F.col("synthesiser"), ROLES["synthesiser"]).alias("s")).select("review_id", "s.*")
