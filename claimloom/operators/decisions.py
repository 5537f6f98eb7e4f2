"""Claim decisions: a model's mapping of a candidate, assessed against accepted knowledge, ontology and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from . import claims, requests, shacl
from .records import DECISION_OUTPUT, parsed, shape_error

MOST_ACCEPTED = 16


def context_error(accepted, most: int = MOST_ACCEPTED):
    """A decision's context holds accepted mappings alone, and no more than it may: it is refused, not cut."""
    return F.when(F.size(accepted) > most, "size").when(~F.forall(accepted, lambda m: m["disposition"] == "accepted"), "disposition")


def decide(outputs: DataFrame, accepted: DataFrame, ontology: DataFrame, shapes: list[shacl.Shape]) -> DataFrame:
    """Mappings of outputs (claim_id, time, output): fields of the output with the assessment worked in, and diagnostic where the output has not its shape.

    accepted has claim_id, subject, predicate, object, object_kind, time; ontology is triples. A
    batch's proposed assertions are checked by the shapes together with accepted knowledge;
    violations count against the claims whose subjects are their focus."""
    read = outputs.withColumn("diagnostic", shape_error(DECISION_OUTPUT)(F.col("output")))
    sound = read.where("diagnostic is null").select("claim_id", "time", parsed(F.col("output"), DECISION_OUTPUT).alias("o")).select("claim_id", "time", "o.*").withColumnRenamed("semantic_assertions", "assertions")
    proposed = sound.where("disposition = 'accepted'").select("claim_id", "time", F.inline("assertions"))  # claims not accepted are not assessed
    told = lambda rows, text, name: rows.withColumn("t", text).groupBy("claim_id").agg(F.array_sort(F.collect_set("t")).alias(name))
    gaps = told(claims.unknown_predicates(proposed, ontology), F.format_string("Active Ontology does not represent predicate %s.", quoted(F.col("predicate"))), "gaps")
    clashes = told(claims.conflicts(proposed, accepted), F.format_string("Conflicts with accepted Claim %s on %s and %s.", *[quoted(F.col(c)) for c in ("accepted_claim_id", "subject", "predicate")]), "clashes")
    triple = lambda rows: rows.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.col("object_kind").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    broken = shacl.validate(triple(proposed).union(triple(accepted)).distinct(), shapes)
    violations = told(proposed.select("claim_id", F.col("subject").alias("focus")).distinct().join(broken, "focus"), F.format_string("%s of %s at %s is violated.", "rule", "shape", "path"), "violations")
    assessed = sound.join(gaps, "claim_id", "left").join(violations, "claim_id", "left").join(clashes, "claim_id", "left")
    done = claims.apply_assessment(assessed)
    return done.withColumn("diagnostic", F.lit(None).cast("string")).unionByName(read.where("diagnostic is not null").select("claim_id", "time", "diagnostic"), allowMissingColumns=True)


def decide_requests(asked: DataFrame, recorded: DataFrame, accepted: DataFrame, ontology: DataFrame, shapes: list[shacl.Shape], *fields: str) -> tuple[DataFrame, DataFrame]:
    """Durable decisions of asked (claim_id, time, ...): its requests (made of fields) with results bound to them, and the decided mappings.

    A request without a recorded output has a null output and is not decided."""
    made = requests.resolve(requests.create(asked, "claim-decision", *fields), recorded, "claim-decision")
    return made, decide(made.where("output is not null").select("claim_id", "time", "output"), accepted, ontology, shapes)


def replayed(asked: DataFrame, results: DataFrame, accepted: DataFrame, ontology: DataFrame, shapes: list[shacl.Shape]) -> tuple[DataFrame, DataFrame]:
    """As decide_requests, from requests and results that were kept: nothing is asked anew, and what is not bound to its request has a diagnostic."""
    made = requests.replay(asked, results)
    return made, decide(made.where("diagnostic is null and output is not null").select("claim_id", "time", "output"), accepted, ontology, shapes)
