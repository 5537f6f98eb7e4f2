"""A content-addressed store of JSON artefacts: parquet partitioned by kind, each row named by the hash of its canonical bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json

SCHEMA_VERSION = "1"
DDL = "sha256 string, schema_version string, payload string, kind string"


class IntegrityError(ValueError):
    """Stored bytes are not those that their name promises."""


def envelope(payload: Column) -> Column:
    """Canonical bytes of an artefact; null where payload is not JSON."""
    return canonical_json(F.concat(F.lit('{"payload":'), payload, F.lit(f',"schema_version":"{SCHEMA_VERSION}"}}')))


def sealed(payload: Column) -> Column:
    """envelope of a payload that is canonical JSON already, or null: no Python is asked."""
    return F.concat(F.lit('{"payload":'), payload, F.lit(f',"schema_version":"{SCHEMA_VERSION}"}}'))


def named(rows: DataFrame, kind: str, payload: str) -> DataFrame:
    """Rows of the store for a column of JSON payloads, one for each content."""
    body = canonical_json(F.col(payload))
    out = rows.select(F.sha2(envelope(F.col(payload)), 256).alias("sha256"), F.lit(SCHEMA_VERSION).alias("schema_version"), body.alias("payload"), F.lit(kind).alias("kind"))
    return out.dropDuplicates(["sha256"])


def reference(sha: Column, kind: Column) -> Column:
    return F.struct(F.concat(F.lit("sha256:"), sha).alias("identity"), kind.alias("kind"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def reference_error(ref: Column) -> Column:
    """First wrong field of a reference struct, null if none is."""
    return F.when(~F.coalesce(ref["identity"].rlike(r"(?s)^sha256:.{64}$"), F.lit(False)), "identity").when(~F.coalesce(ref["kind"].rlike(r"^[^/\\]+$") & ~ref["kind"].isin(".", ".."), F.lit(False)), "kind").when(~F.coalesce(ref["schema_version"] == SCHEMA_VERSION, F.lit(False)), "schema_version")


def write(rows: DataFrame, path: str, kind: str, payload: str = "payload") -> DataFrame:
    """Appends what the store does not hold; gives all the rows' names. One writer at a time."""
    spark = rows.sparkSession
    if not kind or "/" in kind or "\\" in kind or kind in (".", ".."):
        raise ValueError(f"kind {kind!r} is not a single path component")
    new = named(rows, kind, payload)
    try:
        there = read(spark, path, kind).select("sha256")
    except _missing():
        there = None
    (new if there is None else new.join(there, "sha256", "left_anti")).write.mode("append").partitionBy("kind").parquet(path)
    return new.select(reference(F.col("sha256"), F.col("kind")).alias("reference"))


def _missing() -> type[Exception]:
    from pyspark.errors import AnalysisException

    return AnalysisException


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The store's rows of one kind; only its partition is read."""
    return spark.read.schema(DDL).parquet(path).where(F.col("kind") == kind)


def verified(rows: DataFrame) -> DataFrame:
    """rows with diagnostic: null where the payload gives the name and the version is known."""
    right = F.sha2(envelope(F.col("payload")), 256)
    return rows.withColumn("diagnostic", F.when(~right.eqNullSafe(F.col("sha256")), "does not match its identity").when(F.col("schema_version") != SCHEMA_VERSION, "schema version is unknown"))


def require_valid(rows: DataFrame) -> DataFrame:
    """rows, if none has a diagnostic; else the first ones are raised."""
    bad = rows.where("diagnostic is not null").limit(5).collect()
    if bad:
        raise IntegrityError("; ".join(f"{r.sha256}: {r.diagnostic}" for r in bad))
    return rows.drop("diagnostic")


def missing(references: DataFrame, store: DataFrame) -> DataFrame:
    """references (with a column identity) that the store does not hold."""
    return references.join(store.select(F.concat(F.lit("sha256:"), "sha256").alias("held")), F.col("identity") == F.col("held"), "left_anti")


def set_pointer(spark: SparkSession, path: str, identity: str) -> None:
    """Names the current release: one row, written anew."""
    spark.createDataFrame([(identity,)], "identity string").coalesce(1).write.mode("overwrite").parquet(path)


def pointer(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).first().identity
