"""Durable requests, histories, ontology evolution, and answers that once were wrong."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.__main__ import main
from claimloom.functions.text import quoted
from claimloom.operators import analytics, canonical, decisions, history, ontology, quads, requests, review, temporal
from claimloom.plans import sparql, workflow
from claimloom.sources import artefacts, reasoning

QUADS = "g string, s string, p string, o string, o_kind string, o_datatype string"
XSD = "http://www.w3.org/2001/XMLSchema#"


def answers(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_terms_meet_by_kind_and_datatype(spark):
    q = spark.createDataFrame(
        [("g", "urn:a", "urn:says", "urn:b", "literal", None), ("g", "urn:b", "urn:is", "1", "literal", XSD + "integer"), ("g", "urn:c", "urn:is", "1", "literal", None), ("g", "urn:d", "urn:is", "1", "literal", XSD + "string"), ("g", "urn:a", "urn:to", "urn:b", "iri", None)], QUADS
    )
    assert answers(sparql.select(q, "SELECT ?x ?v WHERE { ?x <urn:says> ?y . ?y <urn:is> ?v }")) == []
    assert answers(sparql.select(q, "SELECT ?x ?v WHERE { ?x <urn:to> ?y . ?y <urn:is> ?v }")) == [("urn:a", "1")]
    assert answers(sparql.select(q, 'SELECT ?x WHERE { ?x <urn:is> "1" }')) == [("urn:c",), ("urn:d",)]
    assert answers(sparql.select(q, f'SELECT ?x WHERE {{ ?x <urn:is> "1"^^<{XSD}integer> }}')) == [("urn:b",)]
    assert answers(sparql.select(q, "SELECT DISTINCT ?v WHERE { ?x <urn:is> ?v }")) == [("1",), ("1",)]


def test_a_branch_may_leave_a_variable_to_a_later_pattern(spark):
    q = spark.createDataFrame([("g", "urn:a", "urn:p", "urn:x", "iri", None), ("g", "urn:b", "urn:q", "urn:y", "iri", None), ("g", "urn:b", "urn:p", "urn:z", "iri", None)], QUADS)
    got = answers(sparql.select(q, "SELECT ?s ?v WHERE { { ?s <urn:p> ?v } UNION { ?s <urn:q> ?w } ?s <urn:p> ?v }"))
    assert got == [("urn:a", "urn:x"), ("urn:b", "urn:z"), ("urn:b", "urn:z")]


def test_overlaps_are_told_in_utc(spark):
    c = lambda low, high: temporal.during(F.lit(low), F.lit(high))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            day, hour = c("2024-01-02", "2024-01-03"), c("2024-01-03T01:00Z", "2024-01-03T02:00Z")
            late = c("2024-01-02T23:30:00+00:00", "2024-01-03T02:00Z")
            r = spark.range(1).select(temporal.overlaps(day, hour), temporal.overlaps(day, late), temporal.strictly_stronger(c("2024-01-02T00:00Z", "2024-01-02T10:00Z"), day)).first()
            assert tuple(r) == (False, True, True), zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_configurations():
    assert reasoning.check_configuration({"presence_penalty": 1, "n": 2}) == '{"n":2,"presence_penalty":1}'
    for bad in ({"headers": {}}, {"plugins": [{"openrouter_api_key": "x"}]}, {"reasoning": {"X-API-Key": "x"}}, {"response_schema": {}}):
        with pytest.raises(ValueError):
            reasoning.check_configuration(bad)
    assert reasoning.settings({"timeout": 5, "seed": 1}) == {"max_retries": 0, "timeout": 5, "seed": 1}
    assert reasoning.output_schema('{"output_schema": {"type": "array"}}') == {"type": "array"}
    assert reasoning.output_schema("[1]") == reasoning.output_schema('{"a": 1}') == reasoning.ANY_OBJECT
    with pytest.raises(ValueError):
        reasoning.output_schema('{"output_schema": 3}')


def test_audit_records(spark, tmp_path):
    rows = spark.createDataFrame([("a \"stage\"", '{"q":1}', '{"ok":1}', ['{"attempt":1}']), ("b", "[2]", None, [])], "stage string, request string, output string, history array<string>")
    assert reasoning.audit(rows, str(tmp_path), "local", "m", {"seed": 1}).count() == 2
    got = sorted((json.loads(r.payload) for r in artefacts.read(spark, str(tmp_path), "reasoning-invocation").collect()), key=lambda x: x["stage"])
    assert got[0] == {"stage": 'a "stage"', "provider": "local", "model": "m", "parameters": {"seed": 1}, "structured_input": {"q": 1}, "structured_output": {"ok": 1}, "retry_history": [{"attempt": 1}]}
    assert got[1]["structured_output"] is None and got[1]["retry_history"] == []


def test_chains_that_break_are_told(spark):
    long = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(200)]
    rows = long + [("x", "gone"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "q"), ("alone", "alone")]
    got = {r.decision_id: (r.step, r.diagnostic) for r in history.walk(spark.createDataFrame(rows, "decision_id string, previous_id string")).collect()}
    assert all(got[f"n{i}"] == (i, None) for i in range(200))
    assert got["x"] == got["y"] == (None, "missing")
    assert got["p"] == got["q"] == got["r"] == got["alone"] == (None, "cycle")
    assert history.walk(spark.createDataFrame([], "decision_id string, previous_id string")).count() == 0


def test_appended_decisions_have_the_ids_of_their_content(spark):
    none = spark.createDataFrame([], "decision_id string, previous_id string, kind string, sources array<string>, targets array<string>, reversed_id string, provenance string")
    new = spark.createDataFrame([(None, "merge", ["a", "b"], ["c"], None, "{}"), (None, "merge", ["a"], ["c"], None, "{}")], "previous_id string, kind string, sources array<string>, targets array<string>, reversed_id string, provenance string")
    first = history.append(none, new)
    assert sorted(r.error or "" for r in first.collect()) == ["", "sources"]
    kept = first.where("error is null").drop("error").select(*none.columns)
    assert [r.error for r in history.identity_error(kept).collect()] == [None]
    assert [r.error for r in history.identity_error(kept.withColumn("targets", F.array(F.lit("z")))).collect()] == ["decision_id"]
    head = kept.first().decision_id
    undo = spark.createDataFrame([(head, "reversal", [], [], head, "{}"), ("other", "reversal", [], [], head, "{}")], new.schema)
    assert {r.previous_id: r.error for r in history.append(kept, undo).collect()} == {head: None, "other": "head"}


def test_rows_that_share_a_key_keep_their_own_text(spark):
    rows = spark.createDataFrame([(1, '{"a": "x"}'), (1, '{"a": "y", "b": [1, "z"]}'), (None, '{"a": "w"}'), (2, "{")], "k int, body string")
    got = sorted(r.canonical_text for r in canonical.canonical_documents(rows, "k", "body").collect())
    assert got == ["", "/a:\nw\n", "/a:\nx\n", "/a:\ny\n\n/b/1:\nz\n"]


def test_names_are_quoted_as_python_does(spark):
    texts = ["plain", "it's", 'say "it\'s"', "back\\slash", "line\nfeed", "é\u200b", None]
    got = [r.q for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(quoted(F.col("t")).alias("q")).collect()]
    assert got == [repr(t) if t is not None else None for t in texts]


def test_identity_of_evidence(spark):
    body = '{"content_id":"c1","base_path":"/p"}'
    cases = [
        (body, "c1", "https://s/p", None), (body, "c2", "https://s/p", "content_id"), (body, "c1", "https://s/q", "source_url"), ("[1]", "c1", "x", "source_json"), ("{", "c1", "x", "source_json"), (None, "c1", "x", "source_json"),
        ('{"content_id":1,"base_path":"/p"}', "1", "https://s/p", "content_id"), ('{"content_id":"","base_path":"/p"}', "", "https://s/p", "content_id"), ('{"content_id":"c1","base_path":"p"}', "c1", "https://sp", "source_url"), ('{"content_id":"c1"}', "c1", None, "source_url"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, body string, content_id string, source_url string")
    anchor = F.struct("content_id", "source_url")
    assert [r.e for r in rows.orderBy("i").select(canonical.identity_error(anchor, F.col("body"), "https://s").alias("e")).collect()] == [c[3] for c in cases]


def test_decisions_are_asked_once_and_replayed(spark):
    output = json.dumps({"acceptance": "a", "conflict": "c", "disposition": "accepted", "mapping": "m", "scope": "s", "semantic_assertions": [{"subject": "urn:s", "predicate": "urn:it's", "object": "1", "object_kind": "literal"}], "validation": "v"})
    asked = spark.createDataFrame([("c1", 1), ("c2", 2)], "claim_id string, n int").withColumn("time", temporal.unresolved())
    recorded = spark.createDataFrame([("claim-decision", '{"claim_id":"c1","n":1}', output, 0)], "stage string, structured_input string, structured_output string, sequence int")
    accepted = spark.createDataFrame([], f"claim_id string, subject string, predicate string, object string, object_kind string, time {temporal.DDL}")
    known = spark.createDataFrame([("urn:x", "urn:y", "urn:z")], "s string, p string, o string")
    made, done = decisions.decide_requests(asked, recorded, accepted, known, [], "claim_id", "n")
    assert {r.claim_id: r.output is None for r in made.collect()} == {"c1": False, "c2": True}
    (row,) = done.collect()
    assert row.disposition == "ontology_gap" and row.mapping == 'Active Ontology does not represent predicate "urn:it\'s".'
    again, redone = decisions.replayed(made.drop("output", "result", "result_id"), made.where("output is not null"), accepted, known, [])
    assert {r.claim_id: r.diagnostic for r in again.collect()} == {"c1": None, "c2": "missing"} and redone.first().mapping == row.mapping
    two = made.where("claim_id = 'c1'").select("result", "result_id")
    other = two.select(F.replace("result", F.lit('"m"'), F.lit('"n"')).alias("result")).withColumn("result_id", requests.identity(F.col("result")))
    assert requests.replay(made.where("claim_id = 'c1'").drop("output", "result", "result_id"), two.union(other)).first().diagnostic == "repeated"


def test_ontology_evolution(spark, tmp_path):
    path = str(tmp_path)
    reference = ontology.vendor(spark.createDataFrame([('{"turtle":"x"}',)], "payload string"), f"{path}/store").first().reference
    assert reference.kind == "external-ontology"
    with pytest.raises(ValueError):
        ontology.record_decision(spark.createDataFrame([('{"stage":"judge"}',)], "payload string"), path)
    assert ontology.record_decision(spark.createDataFrame([('{"stage":"critic"}',)], "payload string"), f"{path}/store").count() == 1
    gap = spark.createDataFrame([("r1", "m1", "claim-mapping"), ("r2", "m2", "claim-mapping"), ("r3", "m1", "claim")], "research_id string, identity string, kind string")
    mappings = spark.createDataFrame([("m1", "ontology_gap"), ("m2", "accepted")], "identity string, disposition string")
    store = spark.createDataFrame([(reference.identity, "external-ontology")], "identity string, kind string")
    external = spark.createDataFrame([("r1", reference.identity), ("r2", "sha256:none")], "research_id string, identity string")
    assert {tuple(r) for r in ontology.prompt_error(gap, mappings, external, store).collect()} == {
        ("r2", "Research must be prompted by an Ontology-gap Claim."), ("r3", "Research must be prompted by a Claim mapping."), ("r2", "Reference does not identify an external Ontology artefact."),
    }
    made = ontology.prompt_research(spark.createDataFrame([('{"query": "q"}', reference), ("{}", reference)], "research string, ontology_gap struct<identity:string,kind:string,schema_version:string>"), f"{path}/store")
    assert made.count() == 2
    assert {json.loads(r.payload)["ontology_gap"]["identity"] for r in artefacts.read(spark, f"{path}/store", "ontology-research").collect()} == {reference.identity}

    shapes = "@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:s> a sh:NodeShape ; sh:targetClass <urn:C> ."
    told = spark.createDataFrame([(1, "no")], "ord int, diagnostic string")
    again = spark.createDataFrame([('{"claim_id":"c"}',)], "payload string")
    current, ok = ontology.consider(spark, path, "<urn:C> a <urn:D> .", shapes, told, again, None)
    assert (current, ok) == (None, False)
    current, ok = ontology.consider(spark, path, "<urn:C> a <urn:D> .", shapes, told.limit(0), again, None)
    assert ok and artefacts.pointer(spark, f"{path}/current") == current and artefacts.read(spark, f"{path}/store", "claim-mapping").count() == 1
    kept, ok = ontology.consider(spark, path, "nonsense", shapes, told.limit(0), again, current)
    assert (kept, ok) == (current, False) and artefacts.pointer(spark, f"{path}/current") == current
    records = [json.loads(r.payload) for r in artefacts.read(spark, f"{path}/store", "ontology-evolution").collect()]
    assert sorted((r["status"], tuple(r["diagnostics"])) for r in records) == [("accepted", ()), ("failed", ("Proposed Ontology release is not valid Turtle.",)), ("failed", ("no",))]
    assert artefacts.read(spark, f"{path}/store", "ontology-release").count() == 2


def test_vendored_artefacts_for_later_roles(spark):
    rows = spark.createDataFrame([("r", 1, "b"), ("r", 0, "a"), ("q", 0, "none")], "review_id string, position int, identity string")
    store = spark.createDataFrame([("a", "external-ontology", '{"x":1}'), ("b", "external-ontology", "[]")], "identity string, kind string, payload string")
    (got,) = review.vendored(rows, store).collect()
    assert json.loads(got.vendored) == [{"artefact": {"identity": i, "kind": "external-ontology", "schema_version": "1"}, "content": c} for i, c in (("a", {"x": 1}), ("b", []))]


def test_a_document_is_resolved_entities_first(spark):
    recorded = spark.createDataFrame([("entity-resolution", '{"m":1}', '{"kind":"existing","entity_id":"e"}', 0)], "stage string, structured_input string, structured_output string, sequence int")
    out = workflow.resolution().run(
        mentions=spark.createDataFrame([("m", ["e"], '{"m":1}')], "mention string, candidates array<string>, payload string"),
        expressions=spark.createDataFrame([("2024-05", None, "{}")], "expression string, reference string, payload string"), recorded=recorded,
    )
    assert list(out)[-2:] == ["entities", "times"] and out["entities"].first().entity_id == "e" and out["times"].first().methodology == "calendar"


def test_datasets_and_commands(spark, tmp_path):
    corpus = tmp_path / "corpus"
    (corpus / "source-documents").mkdir(parents=True)
    body = b'{"content_id":"c","title":"T"}'
    import hashlib

    sha = hashlib.sha256(body).hexdigest()
    (corpus / "source-documents" / "00000.json").write_bytes(body)
    entry = {"sequence": 0, "base_path": "/t", "content_id": "c", "source_json": "source-documents/00000.json", "source_json_sha256": sha, "source_version": f"content_id:c:sha256:{sha}"}
    (corpus / "manifest.json").write_text(json.dumps({"schema_version": "1", "status": "complete", "source_documents": [entry]}))
    q = spark.createDataFrame([("urn:g", "urn:a", "urn:p", "x", "literal", None)], QUADS)
    for inside in (f"{corpus}/out", f"{corpus}/a/../b", str(corpus)):
        with pytest.raises(ValueError):
            quads.write_dataset(q, inside, str(corpus))
    main(["dataset", str(corpus), str(tmp_path / "out")])
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 3 + 2 * 4 and any('"\\"T\\""' in x for x in lines)
    (tmp_path / "c.json").write_text('{"seed": 1}')
    main(["experiment", str(tmp_path / "c.json"), str(tmp_path / "lineage")])
    assert (tmp_path / "lineage" / "lineage.json").exists()


def test_claims_that_do_not_fit(spark):
    rows = spark.createDataFrame([("a", "accepted"), ("b", "rejected"), ("c", "ontology_gap")], "claim_id string, disposition string").select("*", *[F.lit(x).alias(x) for x in ("mapping", "validation", "conflict", "scope", "acceptance")])
    assert answers(analytics.misfits(rows)) == [("b", "rejected", "acceptance"), ("c", "ontology_gap", "mapping")]
