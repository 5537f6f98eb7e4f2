"""Claim mappings: validity, gaps in the ontology, conflicts, and what these make of a disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank
from .temporal import ends, meet

#: What may become of a claim.
DISPOSITIONS = (
    "accepted", "ontology_gap", "constraint_violation", "conflict", "unresolved_entity", "unresolved_time", "out_of_scope", "low_confidence", "rejected", "superseded",
)
IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>\"{}|^`\\]*$"
#: Ontologies are broadcast up to so many terms.
FEW_TERMS = 200_000


def mapping_error(disposition: Column, assertions: Column, evidence: Column) -> Column:
    """First broken rule: the disposition is known; evidence is there; exactly accepted mappings hold assertions; IRIs are IRIs."""
    iri = lambda c: F.coalesce(c.rlike(IRI), F.lit(False))
    ok = F.forall(assertions, lambda a: iri(a["subject"]) & iri(a["predicate"]) & ((a["object_kind"] == "literal") | (a["object_kind"] == "iri") & iri(a["object"])))
    rules = [
        (~F.coalesce(disposition.isin(*DISPOSITIONS), F.lit(False)), "disposition"),
        (F.coalesce(F.size(evidence), F.lit(0)) == 0, "evidence"),
        ((disposition == "accepted") != (F.size(assertions) > 0), "assertions"),
        (~F.coalesce(ok, F.lit(True)), "iri"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def candidate_error(assertion: Column, confidence: Column, rationale: Column) -> Column:
    rules = [(~non_blank(assertion), "assertion"), (~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence"), (~non_blank(rationale), "rationale")]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def conflicts(proposed: DataFrame, accepted: DataFrame) -> DataFrame:
    """(claim_id, accepted_claim_id, subject, predicate, object, accepted_object) of assertions with one subject and predicate, another object or kind, and times that overlap.

    Both have claim_id, subject, predicate, object, object_kind and time (a constraint or null).
    The join is by equality on subject and predicate; a skewed pair is split by adaptive execution.
    A claim's own earlier mapping conflicts too."""
    p, a = (rows.withColumn("ends_", ends(F.col("time"))).alias(name) for rows, name in ((proposed, "p"), (accepted, "a")))
    same = (F.col("p.subject") == F.col("a.subject")) & (F.col("p.predicate") == F.col("a.predicate"))
    other = (F.col("p.object") != F.col("a.object")) | (F.col("p.object_kind") != F.col("a.object_kind"))
    met = p.join(a, same & other & meet(F.col("p.ends_"), F.col("a.ends_")))
    return met.select("p.claim_id", F.col("a.claim_id").alias("accepted_claim_id"), "p.subject", "p.predicate", "p.object", F.col("a.object").alias("accepted_object"))


def unknown_predicates(assertions: DataFrame, triples: DataFrame) -> DataFrame:
    """Assertions whose predicate is neither subject nor object of a triple (s, p, o, ...) of the ontology."""
    terms = triples.select(F.col("s").alias("term")).union(triples.select("o")).distinct()
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        terms = F.broadcast(terms)
    return assertions.join(terms, F.col("predicate") == F.col("term"), "left_anti")


def apply_assessment(mappings: DataFrame) -> DataFrame:
    """mappings with gaps, violations and clashes (arrays of reasons) worked in: a gap counts before a violation, that before a conflict; none of them leaves assertions. Mappings not accepted are left as they are."""
    has = lambda c: (F.col("disposition") == "accepted") & (F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0)
    text = lambda c: F.array_join(c, " ")
    gap, broken, clash = has("gaps"), has("violations"), has("clashes")
    pick = lambda column, *three: F.coalesce(*[F.when(when, what) for when, what in zip((gap, broken, clash), three)], F.col(column))
    some = lambda c: F.when(F.length(text(c)) > 0, text(c)).otherwise("No conflict was detected against accepted knowledge.")
    own = F.col
    changed = {
        "disposition": pick("disposition", F.lit("ontology_gap"), F.lit("constraint_violation"), F.lit("conflict")),
        "mapping": pick("mapping", text("gaps"), own("mapping"), own("mapping")),
        "validation": pick("validation", own("validation"), text("violations"), own("validation")),
        "conflict": pick("conflict", own("conflict"), some("clashes"), text("clashes")),
        "acceptance": pick("acceptance", F.lit("The Claim awaits Ontology review."), F.lit("The Claim cannot enter accepted knowledge."), F.lit("The Claim conflicts with accepted knowledge.")),
        "assertions": F.when(gap | broken | clash, F.array().cast(mappings.schema["assertions"].dataType)).otherwise(F.col("assertions")),
    }
    return mappings.withColumns(changed)
