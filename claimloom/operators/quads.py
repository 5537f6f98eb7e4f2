"""Quads (g, s, p, o, o_kind, o_datatype) of source documents and claims. A quad set holds no quad twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import arrow_function
from ..functions.text import compact_json, float_text, percent_encoded

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
COLUMNS = ("g", "s", "p", "o", "o_kind", "o_datatype")


@dataclass(frozen=True)
class Vocabulary:
    """Where a deployment's own names live."""

    base: str = "https://kg.example.org/"

    def __call__(self, name: str) -> str:
        return self.base + name


def quad(graph: str, subject: Column, predicate: str | Column, value: Column, kind: str | Column = "literal", datatype: str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(graph).alias("g"), subject.alias("s"), as_column(predicate).alias("p"), value.alias("o"), as_column(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))


def quads_of(rows: DataFrame, *each: Column) -> DataFrame:
    """One pass over rows that gives all their quads."""
    return rows.select(F.inline(F.array(*each)))


def document_node(content_id: Column, sha: Column, v: Vocabulary = Vocabulary()) -> Column:
    """A node of one version of one document."""
    return F.concat(F.lit(v("source-document/")), percent_encoded(content_id), F.lit("/"), sha)


def source_quads(documents: DataFrame, content_id: str, body: str, sha: str, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Three quads for a document, four for each key of its JSON object."""
    graph, json_type = v("graph/source-documents"), RDF + "JSON"
    rows = documents.select(document_node(F.col(content_id), F.col(sha), v).alias("node"), F.col(body).alias("body"), F.concat(F.lit("content_id:"), content_id, F.lit(":sha256:"), sha).alias("version"))
    node = F.col("node")
    whole = quads_of(
        rows,
        quad(graph, node, RDF + "type", F.lit(v("SourceDocument")), "iri"),
        quad(graph, node, v("sourceJson"), F.col("body"), "literal", json_type),
        quad(graph, node, v("sourceVersion"), F.col("version")),
    )
    pairs = rows.select("node", F.explode(_entries(F.col("body"))).alias("e")).select("node", "e.*")
    claim = F.concat(node, F.lit("/assertion/"), percent_encoded(F.col("key")))
    each = quads_of(
        pairs,
        quad(graph, claim, RDF + "type", F.lit(v("SourceAssertion")), "iri"),
        quad(graph, claim, v("about"), node, "iri"),
        quad(graph, claim, v("sourceKey"), F.col("key")),
        quad(graph, claim, v("sourceValue"), F.col("value"), "literal", json_type),
    )
    return whole.unionByName(each).dropDuplicates()


@arrow_function("array<struct<key:string,value:string>>")
def _entries(text):
    """The keys of a JSON object, each with its value as compact JSON."""
    import json

    try:
        found = json.loads(text) if text is not None else None
    except ValueError:
        found = None
    return [{"key": k, "value": json.dumps(x, ensure_ascii=False, separators=(",", ":"))} for k, x in found.items()] if isinstance(found, dict) else []


REASONS = {"mappingReason": "mapping", "validationReason": "validation", "conflictReason": "conflict", "scopeReason": "scope", "acceptanceReason": "acceptance"}


def claim_node(claim_id: Column, v: Vocabulary = Vocabulary()) -> Column:
    return F.concat(F.lit(v("claim/")), percent_encoded(claim_id))


def claim_quads(mappings: DataFrame, v: Vocabulary = Vocabulary()) -> DataFrame:
    """Quads of claim mappings: columns claim_id, assertion, confidence, rationale, times_json, evidence_json (array), disposition, the five reasons, assertions (array of subject, predicate, object, object_kind).

    Accepted claims put their assertions into the graph of accepted knowledge and restate them
    as statements, numbered from 0, in the claims graph."""
    graph, accepted, json_type = v("graph/claims"), v("graph/accepted-knowledge"), RDF + "JSON"
    rows = mappings.withColumn("node", claim_node(F.col("claim_id"), v))
    node = F.col("node")
    plain = quads_of(
        rows,
        quad(graph, node, RDF + "type", F.lit(v("Claim")), "iri"),
        quad(graph, node, v("claimAssertion"), F.col("assertion")),
        quad(graph, node, v("claimConfidence"), float_text(F.col("confidence"))),
        quad(graph, node, v("claimRationale"), F.col("rationale")),
        quad(graph, node, v("claimTime"), compact_json(F.col("times_json")), "literal", json_type),
        quad(graph, node, v("disposition"), F.col("disposition")),
        *[quad(graph, node, v(p), F.col(c)) for p, c in REASONS.items()],
    )
    proof = quads_of(rows.select("node", F.explode("evidence_json").alias("e")), quad(graph, node, v("evidence"), compact_json(F.col("e")), "literal", json_type))
    stated = rows.where("disposition = 'accepted'").select("node", F.posexplode("assertions").alias("i", "a"))
    statement = F.concat(node, F.lit("/assertion/"), F.col("i").cast("string"))
    a = lambda k: F.col("a")[k]
    kind = F.when(a("object_kind") == "iri", "iri").otherwise("literal")
    projected = quads_of(
        stated,
        quad(accepted, a("subject"), a("predicate"), a("object"), kind),
        quad(graph, node, v("projectsAssertion"), statement, "iri"),
        quad(graph, statement, RDF + "type", F.lit(RDF + "Statement"), "iri"),
        quad(graph, statement, RDF + "subject", a("subject"), "iri"),
        quad(graph, statement, RDF + "predicate", a("predicate"), "iri"),
        quad(graph, statement, RDF + "object", a("object"), kind),
    )
    return plain.unionByName(proof).unionByName(projected).where("o is not null").dropDuplicates()


def nquads(quads: DataFrame) -> DataFrame:
    """(value): a line of N-Quads for each quad."""
    text = F.col("o")
    for mark, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(mark), F.lit(escape))
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("^^"), iri(F.col("o_datatype"))), F.lit("")))
    return quads.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(literal), iri(F.col("g")), F.lit(".")).alias("value"))


def write_dataset(quads: DataFrame, path: str, corpus: str) -> None:
    """Writes quads as N-Quads text; a path inside the corpus, or one that holds anything, is refused."""
    import posixpath

    plain = lambda p: posixpath.normpath(p.removeprefix("file://")).rstrip("/")
    if f"{plain(path)}/".startswith(f"{plain(corpus)}/"):
        raise ValueError("a dataset may not stand inside its corpus")
    nquads(quads).write.mode("error").text(path)
