"""Open extraction: a model's output for a source version, checked against the source it is drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import anchor_error
from .records import EXTRACTION, parsed, shape_error

IDENTITY = ("canonicaliser_version", "source_json_sha256", "content_id", "source_url", "canonical_text_sha256")


def source_error(text, sha, version, known: str = "1"):
    """First fault of a canonical text beside its hash and version."""
    return F.when(~version.eqNullSafe(F.lit(known)), "canonicaliser_version").when(~F.sha2(text, 256).eqNullSafe(sha), "canonical_text_sha256")


def check_extractions(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """outputs (source_version, output) with diagnostic: the shape's fault, "confidence", or the first field of an anchor that its source contradicts; null if none.

    sources has source_version, canonical_text and the columns of IDENTITY. Each source's text
    is met once by all its anchors."""
    shaped = outputs.withColumn("shape_", shape_error(EXTRACTION, "times")(F.col("output"))).withColumn("o_", parsed(F.col("output"), EXTRACTION))
    evidence = F.flatten(F.concat(*[F.transform(F.col("o_")[k], lambda x: x["evidence"]) for k in ("candidate_claims", "mentions", "temporal_expressions")]))
    anchors = shaped.where("shape_ is null").select("source_version", F.posexplode(evidence).alias("i", "a")).join(sources, "source_version", "left")
    told = F.coalesce(F.when(F.col("canonical_text").isNull(), "source_version"), anchor_error(F.col("a"), F.col("canonical_text"), {c: F.col(c) for c in IDENTITY}))
    first = anchors.withColumn("e", told).where("e is not null").groupBy("source_version").agg(F.min_by("e", "i").alias("anchor_"))
    number = F.exists(F.col("o_")["candidate_claims"], lambda c: ~c["confidence"].between(0, 1))
    joined = shaped.join(first, "source_version", "left")
    return joined.withColumn("diagnostic", F.coalesce("shape_", F.when(number, "confidence"), "anchor_")).drop("shape_", "o_", "anchor_")
