"""Record shapes, extraction, resolution, decisions and reviews."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimloom.operators import decisions, extraction, records, resolution, review, shacl, temporal
from claimloom.sources import lineage

TEXT = "First line.\nApply now.\n"
SHA = hashlib.sha256(TEXT.encode()).hexdigest()
ANCHOR = {
    "canonical_text_sha256": SHA, "canonicaliser_version": "1", "content_id": "id", "end_line": 1, "end_offset": 22, "prefix": "", "selected_text": "Apply now.",
    "source_json_sha256": "b" * 64, "source_url": "https://x/y", "start_line": 1, "start_offset": 12, "suffix": "\n",
}


def errors(spark, ddl, *values, optional=()):
    rows = spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, v string")
    return [r.e for r in rows.select("i", records.shape_error(ddl, *optional)(F.col("v")).alias("e")).orderBy("i").collect()]


def test_closed_shapes(spark):
    got = errors(spark, records.EVIDENCE, ANCHOR, ANCHOR | {"x": 1}, {k: v for k, v in ANCHOR.items() if k != "suffix"}, ANCHOR | {"end_line": True}, ANCHOR | {"prefix": None}, "[", "[]")
    assert got == [None, "x", "suffix", "end_line", "prefix", "json", "record"]
    claim = {"assertion": "a", "confidence": 1, "evidence": [ANCHOR], "rationale": "r"}
    assert errors(spark, records.CANDIDATE, claim, claim | {"evidence": [ANCHOR | {"end_line": 1.5}]}, optional=("times",)) == [None, "evidence[0].end_line"]
    assert errors(spark, records.CANDIDATE, claim) == ["times"]


def test_extractions_are_held_to_their_source(spark):
    claim = {"assertion": "a", "confidence": 0.5, "evidence": [ANCHOR], "rationale": "r"}
    whole = lambda **c: json.dumps({"candidate_claims": [claim | c], "mentions": [{"evidence": [ANCHOR], "text": "now"}], "temporal_expressions": []})
    outputs = [("ok", whole()), ("bad", whole(evidence=[ANCHOR | {"prefix": "x"}])), ("sure", whole(confidence=2)), ("none", json.dumps({"candidate_claims": [], "mentions": [], "temporal_expressions": []})), ("open", '{"x":1}'), ("lost", whole()), ("other", whole())]
    sources = [(v, TEXT, "1", "b" * 64, "id" if v != "other" else "another", "https://x/y", SHA) for v, _ in outputs if v != "lost"]
    df = extraction.check_extractions(
        spark.createDataFrame(outputs, "source_version string, output string"),
        spark.createDataFrame(sources, "source_version string, canonical_text string, canonicaliser_version string, source_json_sha256 string, content_id string, source_url string, canonical_text_sha256 string"),
    )
    assert {r.source_version: r.diagnostic for r in df.collect()} == {"ok": None, "bad": "prefix", "sure": "confidence", "none": None, "open": "x", "lost": "source_version", "other": "content_id"}


def test_times_by_calendar_then_by_record(spark):
    answer = json.dumps({"constraint": {"lower_bound": "2020-05-01", "lower_inclusive": True, "upper_bound": None, "upper_inclusive": True}})
    requests = spark.createDataFrame([("2026", None, '{"e": 1}'), ("in May", None, '{"e":2}'), ("soon", None, '{"e":3}')], "expression string, reference string, payload string")
    recorded = spark.createDataFrame([("temporal-resolution", '{ "e": 2 }', answer, 1), ("temporal-resolution", '{"e":2}', "{}", 2)], "stage string, structured_input string, structured_output string, sequence int")
    got = {r.expression: (r.kind, r.methodology, r.constraint and r.constraint.lower_bound) for r in resolution.resolve_times(requests, recorded).collect()}
    assert got == {"2026": ("resolved", "calendar", "2026-01-01"), "in May": ("resolved", "recorded", "2020-05-01"), "soon": ("unresolved", "none", None)}


def test_citations(spark):
    c = lambda lo, hi: temporal.during(F.lit(lo), F.lit(hi))
    record = lambda e, k: F.struct(F.array(*map(F.lit, e)).alias("evidence"), k.alias("constraint"))
    year, month = c("2020-01-01", "2021-01-01"), c("2020-05-01", "2020-06-01")
    both = F.array(record(["e1"], year), record(["e2"], month))
    e = lambda context, cited, chosen: spark.range(1).select(resolution.citation_error(context, F.array(*map(F.lit, cited)), chosen)).first()[0]
    assert e(both, ["e2"], month) is None and e(both, ["e1"], month) == "evidence" and e(both, ["e1"], year) == "stronger" and e(F.array(record(["e1"], year)), ["e1"], year) is None
    halves = F.array(F.struct(F.array(F.lit("e")).alias("evidence"), F.lit(None).cast(temporal.DDL).alias("constraint")))
    assert spark.range(1).select(resolution.context_error(halves)).first()[0] == "halves"


def test_entities_from_records(spark):
    requests = spark.createDataFrame([("m", ["p", "q"], '{"m":1}'), ("n", ["p"], '{"m":2}'), ("o", ["p"], '{"m":3}')], "mention string, candidates array<string>, payload string")
    recorded = spark.createDataFrame([("entity-resolution", '{"m":1}', '{"kind":"existing","entity_id":"q"}', 1), ("entity-resolution", '{"m":2}', '{"kind":"existing","entity_id":"z"}', 1)], "stage string, structured_input string, structured_output string, sequence int")
    assert {r.mention: (r.kind, r.error) for r in resolution.resolve_entities(requests, recorded).collect()} == {"m": ("existing", None), "n": ("existing", "existing"), "o": ("unresolved", None)}


def output(disposition="accepted", predicate="urn:status", value="available", **extra):
    a = [{"object": value, "object_kind": "literal", "predicate": predicate, "subject": "urn:scheme"}] if disposition == "accepted" else []
    return json.dumps({"acceptance": "a", "conflict": "c", "disposition": disposition, "mapping": "m", "scope": "s", "semantic_assertions": a, "validation": "v"} | extra)


@pytest.mark.parametrize(
    ("text", "want", "reason"),
    [
        (output(value="closed"), "accepted", "a"), (output("out_of_scope"), "out_of_scope", "a"), (output(predicate="urn:new"), "ontology_gap", "The Claim awaits Ontology review."),
        (output(), "conflict", "The Claim conflicts with accepted knowledge."), (output(evidence=[]), None, None),
    ],
)
def test_decisions(spark, text, want, reason):
    accepted = spark.createDataFrame([("old", "urn:scheme", "urn:status", "closed", "literal", None)], f"claim_id string, subject string, predicate string, object string, object_kind string, time {temporal.DDL}")
    known = spark.createDataFrame([("urn:status", "urn:a", "urn:Property")], "s string, p string, o string")
    row = decisions.decide(spark.createDataFrame([("new", None, text)], f"claim_id string, time {temporal.DDL}, output string"), accepted, known, []).first()
    assert (row.disposition, row.acceptance) == (want, reason) and (row.diagnostic is None) == (want is not None)
    if want == "conflict":
        assert row.conflict == "Conflicts with accepted Claim 'old' on 'urn:scheme' and 'urn:status'." and row.assertions == []


def test_a_violated_shape_decides(spark):
    shapes = shacl.read_shapes("PREFIX sh: <http://www.w3.org/ns/shacl#> <urn:s> a sh:NodeShape ; sh:targetNode <urn:scheme> ; sh:property [ sh:path <urn:required> ; sh:minCount 1 ] .")
    none = spark.createDataFrame([], f"claim_id string, subject string, predicate string, object string, object_kind string, time {temporal.DDL}")
    known = spark.createDataFrame([("urn:status", "urn:a", "urn:Property")], "s string, p string, o string")
    row = decisions.decide(spark.createDataFrame([("new", None, output())], f"claim_id string, time {temporal.DDL}, output string"), none, known, shapes).first()
    assert row.disposition == "constraint_violation" and row.conflict == "No conflict was detected against accepted knowledge." and row.validation.startswith("minCount of urn:s")


def test_reviews_replay_all_roles(spark):
    texts = {
        "researcher": {"query": "q", "rationale": "r"},
        "proposer": {"assessments": [{"artefact_index": 0, "rationale": "r", "suitable": True, "term": "urn:t"}, {"artefact_index": 5, "rationale": "r", "suitable": False, "term": "urn:u"}], "conclusion": "c", "rationale": "r"},
        "critic": {"rationale": "r"},
        "synthesiser": {"changes": [], "mapping": json.loads(output()), "ontology_turtle": "", "rationale": "r", "reconsideration_reason": "r", "shacl_turtle": ""},
    }
    before, rows = '{"gap":1}', []
    for role in records.ROLES:
        rows.append((role, before, json.dumps(texts[role]), 1))
        before = f'{{"before":{before},"{role}":{json.dumps(texts[role])}}}'
    recorded = spark.createDataFrame(rows, "stage string, structured_input string, structured_output string, sequence int")
    requests = spark.createDataFrame([("one", '{ "gap": 1 }'), ("two", '{"gap":2}')], "review_id string, payload string")
    done = review.run(requests, recorded)
    assert {r.review_id: (r.failed, r.complete) for r in done.collect()} == {"one": (None, True), "two": ("researcher", False)}
    found = spark.createDataFrame([("one", 0, "sha256:x")], "review_id string, artefact_index int, identity string")
    assert {(r.term, r.identity) for r in review.assessments(done.where("complete"), found).collect()} == {("urn:t", "sha256:x"), ("urn:u", None)}
    assert [r.mapping.disposition for r in review.proposal(done).collect()] == ["accepted"]
    broken = recorded.withColumn("structured_output", F.when(F.col("stage") == "critic", "{}").otherwise(F.col("structured_output")))
    assert {r.failed for r in review.run(requests.limit(1), broken).collect()} == {"critic"}


def test_lineage(spark, tmp_path):
    path = str(tmp_path / "l")
    assert lineage.initialise(spark, path, '{"reasoning_mode": "exact-replay"}') == "sha256:642a0ca2ac943fb20038a8dcb4f2bcf4237ccd00450256cb6c744b14515f1d5e"
    assert json.loads(lineage.configuration(spark, path)) == {"reasoning_mode": "exact-replay"}
    with pytest.raises(FileExistsError):
        lineage.initialise(spark, path, "{}")
    with pytest.raises(ValueError):
        lineage.initialise(spark, str(tmp_path / "m"), "[]")
