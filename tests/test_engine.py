"""Goldens and edge cases of the engine's parts."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from claimloom.functions.markup import render
from claimloom.functions.text import canonical_json, exact_keys, float_text, percent_encoded, plain_text
from claimloom.functions.turtle import RDF, XSD, TurtleError, parse, triples
from claimloom.operators import analytics, canonical, claims, history, ontology, shacl, temporal
from claimloom.plans.sparql import SparqlError, ask, select
from claimloom.plans.workflow import Workflow
from claimloom.sources import artefacts, corpus, reasoning
from claimloom.streaming.ingest import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- text and canonical documents


def test_canonical_json_is_byte_exact(spark):
    text = '{"b": 1.0, "a": [1e-05, 1e10, "\\u00e9"], "a": {"z": null, "y": true}}'
    assert one(spark, canonical_json(F.lit(text)))[0] == '{"a":{"y":true,"z":null},"b":1.0}'
    assert one(spark, canonical_json(F.lit("{")))[0] is None and one(spark, canonical_json(F.lit("NaN")))[0] is None
    assert one(spark, float_text(F.lit(1e-5)))[0] == "1e-05"


def test_text_functions(spark):
    assert one(spark, percent_encoded(F.lit("a b/~*+é")))[0] == "a%20b%2F~%2A%2B%C3%A9"
    assert one(spark, plain_text(F.lit(" a  b \r\n\r\n c\x1c")))[0] == "a b\n\nc"
    assert one(spark, exact_keys(F.lit('{"a":1,"b":2}'), "b", "a"))[0] is True and one(spark, exact_keys(F.lit('{"a":1}'), "b", "a"))[0] is False


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<h2>Help</h2>", "## Help"),
        ("<ul><li>First</li><li>Second</li></ul>", "- First\n\n- Second"),
        ('<p><a href="/apply">Apply</a></p>', "Apply </apply>"),
        ("<table><tr><th>Step</th><th>Action</th></tr></table>", "Step | Action"),
        ("Café", "Café"),
        ("a  b\r\n c ", "a b\nc"),
        ("<p>a</p>\n<p>b<br>c &amp; d</p>", "a\n\nb\n\nc & d"),
    ],
)
def test_rendering(html, text):
    assert render(html) == text


def test_canonical_document_hash(spark):
    body = json.dumps({"title": "Export", "body": "<h1>Export goods</h1><p>Apply online.</p>"})
    row = canonical.canonical_documents(spark.createDataFrame([("x", body), ("y", "{}"), ("z", "[")], "id string, body string"), "id", "body").orderBy("id").collect()
    assert row[0].canonical_text == "/body:\n# Export goods\n\nApply online.\n\n/title:\nExport\n"
    assert row[0].canonical_sha256 == "4537b95d4da91be86fb28e44f4af1825bb15d746ad8bdff70abb3694b706cedb"
    assert row[1].canonical_text == row[2].canonical_text == ""


def test_leaves_stand_in_the_order_of_keys(spark):
    body = json.dumps({"a-b": "2", "a": {"k": ["x", 3, {"/~": "y"}]}})
    rows = canonical.leaf_passages(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").orderBy("order").collect()
    assert [(r.pointer, r.value) for r in rows] == [("/a/k/0", "x"), ("/a/k/2/~1~0", "y"), ("/a-b", "2")]


TEXT = "First line.\nApply now.\nMore. Apply now.\n"


def anchor(**changes):
    good = {"start_offset": 29, "end_offset": 39, "start_line": 2, "end_line": 2, "selected_text": "Apply now.", "prefix": "More. ", "suffix": "\n", "version": "1"}
    return Row(**(good | changes))


@pytest.mark.parametrize(
    ("changes", "error"),
    [
        ({}, None), ({"version": "2"}, "version"), ({"selected_text": ""}, "selected_text"), ({"start_offset": -1}, "offset"), ({"end_offset": 999}, "offset"), ({"end_offset": 29}, "offset"),
        ({"start_offset": 28}, "selected_text"), ({"prefix": "x"}, "prefix"), ({"suffix": "x"}, "suffix"), ({"start_line": 1}, "start_line"), ({"end_line": 3}, "end_line"),
        ({"selected_text": "First line.", "start_offset": 1, "end_offset": 11}, "start_offset"), ({"selected_text": "First line.", "start_offset": 0, "end_offset": 10}, "end_offset"),
    ],
)
def test_anchor_errors(spark, changes, error):
    df = spark.createDataFrame([(anchor(**changes),)], "a struct<start_offset:int,end_offset:int,start_line:int,end_line:int,selected_text:string,prefix:string,suffix:string,version:string>")
    assert df.select(canonical.anchor_error(F.col("a"), F.lit(TEXT), {"version": F.lit("1")})).first()[0] == error


# ---- time


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [
        *((f"{y}-{m:02d}", f"{y}-{m:02d}-01", f"{y + m // 12}-{m % 12 + 1:02d}-01") for y in (2000, 2026) for m in (1, 4, 12)),
        ("2000", "2000-01-01", "2001-01-01"), ("2000-02-29", "2000-02-29", "2000-03-01"), ("2026-12-31", "2026-12-31", "2027-01-01"),
        *((t, None, None) for t in ("2026-13", "2026-02-30", "0000", "9999", "9999-12", "9999-12-31", "26", "2026-1", "next April", "soon")),
    ],
)
def test_calendar(spark, text, low, high):
    c = one(spark, temporal.resolve_calendar(F.lit(text)))[0]
    assert (c and (c.lower_bound, c.upper_bound, c.lower_inclusive, c.upper_inclusive)) == (low and (low, high, True, False))


def test_next_april_counts_from_the_reference_own_date(spark):
    at = lambda text, ref: one(spark, temporal.resolve_calendar(F.lit(text), F.lit(ref)))[0].lower_bound
    assert at("next April", "2026-03-31T23:30:00-01:00") == "2026-04-01" and at("the following April", "2026-04-01T00:00:00Z") == "2027-04-01"


BOUND = st.one_of(st.none(), st.integers(1, 6))


@settings(deadline=None, max_examples=25)
@given(st.lists(st.tuples(BOUND, st.booleans(), BOUND, st.booleans()), min_size=2, max_size=2))
def test_overlap_against_points(spark_once, both):
    """Two constraints overlap if some point, whole or half, lies in both."""
    points = [x / 2 for x in range(-2, 20)]
    holds = lambda c, x: (c[0] is None or x > c[0] or x == c[0] and c[1]) and (c[2] is None or x < c[2] or x == c[2] and c[3])
    if any(not any(holds(c, x) for x in points) for c in both):
        return  # an empty constraint is refused before
    spark = spark_once
    day = lambda n: F.lit(None if n is None else f"2020-01-{n:02d}")
    a, b = (temporal.constraint(day(lo), day(hi), li, hi_inc) for lo, li, hi, hi_inc in both)
    assert one(spark, temporal.overlaps(a, b))[0] == any(holds(both[0], x) and holds(both[1], x) for x in points)


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark


def test_constraint_rules(spark):
    c = lambda lo, li, hi, hi_inc: one(spark, temporal.constraint_error(temporal.constraint(F.lit(lo), F.lit(hi), li, hi_inc)))[0]
    assert c(None, True, None, True) == "bounds" and c("2020-01-01T00:00:00", True, None, True) == "timezone"
    assert c("2020-01-01", True, "2020-01-02T00:00:00Z", True) == "precision" and c(None, False, "2020-01-01", True) == "inclusivity"
    assert c("2020-01-02", True, "2020-01-01", True) == "order" and c("2020-01-01", True, "2020-01-01", False) == "empty" and c("2020-01-01", True, "2020-01-01", True) is None


def test_stronger_by_inclusivity_alone(spark):
    a, b = (temporal.constraint(F.lit("2020-01-01"), F.lit("2020-02-01"), True, inc) for inc in (True, False))
    assert one(spark, temporal.strictly_stronger(a, b))[0] and one(spark, temporal.strictly_stronger(b, a))[0] and not one(spark, temporal.strictly_stronger(a, a))[0]


# ---- graph


TTL = """@prefix ex: <urn:ex:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a a ex:C ; ex:p "x\\n\\"y" , 'z'@en-GB , 4 , 1.5 , true , "3"^^xsd:int ; ex:q [ ex:r ( ex:b 2 ) ] . # done
"""


def test_turtle():
    got = parse(TTL)
    assert ("urn:ex:a", RDF + "type", "urn:ex:C", "iri", None) in got and ("urn:ex:a", "urn:ex:p", 'x\n"y', "literal", None) in got
    assert {t[4] for t in got if t[1] == "urn:ex:p"} == {None, RDF + "langString", *(XSD + k for k in ("integer", "decimal", "boolean", "int"))}
    assert sum(t[1] == RDF + "rest" for t in got) == 2
    for bad in ("ex:a ex:b ex:c .", "<urn:a> <urn:b> .", '"x" <urn:b> <urn:c> .', "<urn:a> <urn:b> <urn:c>", "<urn:a> \"b\" <urn:c> ."):
        with pytest.raises(TurtleError):
            parse(bad)


def test_turtle_as_rows(spark):
    rows = triples(spark.createDataFrame([(1, TTL), (2, "no"), (3, None)], "id int, ttl string"), "ttl", "id").collect()
    assert len([r for r in rows if r.id == 1]) == len(parse(TTL)) and [r.error is not None for r in rows if r.id == 2] == [True]


def quads(spark):
    rows = [("g1", "a", "p", "b", "iri"), ("g1", "a", "q", "x", "literal"), ("g2", "b", "p", "c", "iri"), ("g2", "a", "p", "b", "iri"), ("g2", "c", "q", "b", "literal")]
    pre = lambda v: v if v == "x" or len(v) > 1 else f"urn:{v}"
    return spark.createDataFrame([(f"urn:{g}", pre(s), pre(p), o if k == "literal" else pre(o), k) for g, s, p, o, k in rows], "g string, s string, p string, o string, o_kind string")


def test_graph_queries(spark):
    q = quads(spark)
    rows = select(q, 'PREFIX u: <urn:> SELECT ?s ?t WHERE { ?s u:p ?t . { ?t u:p u:c } UNION { ?t u:q "b" } }').collect()
    assert {tuple(r) for r in rows} == {("urn:a", "urn:b"), ("urn:b", "urn:c")}
    assert select(q, "SELECT DISTINCT ?g WHERE { GRAPH ?g { ?s <urn:p> ?o } }").count() == 2
    assert select(q, "SELECT ?s WHERE { ?s <urn:p> <urn:b> }").count() == 1  # a triple in two graphs counts once
    assert ask(q, 'ASK { <urn:c> <urn:q> "b" }') and not ask(q, "ASK { <urn:c> <urn:q> <urn:b> }")
    for bad in ("SELECT ?s WHERE { ?s <urn:p> ?o FILTER(?o) }", "CONSTRUCT {}", "SELECT ?s WHERE { ?s u:p ?o }"):
        with pytest.raises(SparqlError):
            select(q, bad)


SHAPE = "@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . <urn:s> a sh:NodeShape ; sh:targetNode <urn:a> ; sh:property [ sh:path <urn:p> ; %s ] ."


@pytest.mark.parametrize(
    ("rule", "broken"),
    [
        ("sh:minCount 1", 0), ("sh:minCount 3", 1), ("sh:maxCount 1", 1), ("sh:maxCount 2", 0), ("sh:datatype xsd:string", 1), ("sh:nodeKind sh:IRI", 1), ("sh:nodeKind sh:IRIOrLiteral", 0),
        ('sh:in ( "x" <urn:b> )', 0), ('sh:in ( "y" )', 1), ('sh:hasValue "x"', 0), ('sh:hasValue "q"', 1), ('sh:pattern "x|b"', 0), ('sh:pattern "^x"', 1), ("sh:class <urn:C>", 1),
    ],
)
def test_shapes(spark, rule, broken):
    data = spark.createDataFrame([("urn:a", "urn:p", "x", "literal", None), ("urn:a", "urn:p", "urn:b", "iri", None), ("urn:b", RDF + "type", "urn:C", "iri", None)], "s string, p string, o string, o_kind string, o_datatype string")
    assert shacl.validate(data, shacl.read_shapes(SHAPE % rule)).count() == broken


def test_unsupported_shapes_are_refused():
    for rule in ('sh:minCount "many"', "sh:lessThan <urn:q>"):
        with pytest.raises(shacl.ShapeError):
            shacl.read_shapes(SHAPE % rule)
    assert ontology.release_diagnostics("nonsense", SHAPE % "sh:minCount 1") == ["Proposed Ontology release is not valid Turtle."]
    assert ontology.release_diagnostics("", "<urn:a> a <urn:b> .") == ["Proposed SHACL release defines no NodeShape."]
    assert "integer" in ontology.release_diagnostics("", SHAPE % 'sh:minCount "many"')[0]


def test_ontology_checks(spark):
    terms = spark.createDataFrame([("o", "urn:p"), ("o", "urn:z"), ("other", "urn:p")], "source string, term string")
    known = spark.createDataFrame([("o", "urn:a", "urn:p", "urn:b")], "source string, s string, p string, o string")
    assert {tuple(r) for r in ontology.absent_terms(terms, known).collect()} == {("o", "urn:z"), ("other", "urn:p")}
    again = spark.createDataFrame([("c1", "x"), ("c2", "y"), ("c3", "z"), ("c3", "z")], "claim_id string, candidate string")
    prior = spark.createDataFrame([("c1", "x"), ("c2", "w"), ("c3", "z")], "claim_id string, candidate string")
    assert {(r.claim_id, r.diagnostic) for r in ontology.claim_diagnostics(again, prior).collect()} == {("c1", None), ("c2", "another candidate"), ("c3", "named twice")}
    refs = spark.createDataFrame([("gap", "1", "claim"), ("research", "2", "r"), ("decision", "1", "d")], "role string, sha256 string, kind string")
    got = ontology.reference_diagnostics(refs, spark.createDataFrame([("1", "claim")], "sha256 string, kind string")).collect()
    assert {(r.role, r.diagnostic) for r in got} == {("gap", None), ("research", "research is missing."), ("decision", "decision has another kind.")}
    told = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "ord int, diagnostic string")
    current, stood = ontology.gate("old", "new", told)
    assert current == "old" and [r.diagnostic for r in stood.collect()] == ["a", "b"] and ontology.gate("old", "new", told.limit(0))[0] == "new"


# ---- claims and histories


def test_candidates_and_mappings(spark):
    e = lambda a, c, r: one(spark, claims.candidate_error(F.lit(a), F.lit(c), F.lit(r)))[0]
    assert e("x", 0.5, "y") is None and e(" ", 0.5, "y") == "assertion" and e("x", 1.5, "y") == "confidence" and e("x", 1.0, "") == "rationale"


def test_history_rules(spark):
    a = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    e = lambda kind, s, t: one(spark, history.decision_error(F.lit(kind), s, t))[0]
    assert e("merge", a("x", "y"), a("z")) is None and e("merge", a("x"), a("z")) == "sources" and e("merge", a("x", "y"), a("x")) == "target"
    assert e("split", a("x"), a("y", "z")) is None and e("split", a("x"), a("y", "y")) == "targets" and e("split", a("x"), a("x", "y")) == "source"
    o = lambda kind, who: one(spark, history.outcome_error(F.lit(kind), F.lit(who).cast("string"), a("p", "q")))[0]
    assert o("existing", "p") is None and o("existing", "r") == "existing" and o("provisional", "q") == "provisional" and o("unresolved", None) is None
    assert one(spark, history.decision_id(F.lit('{"b": 1, "a": ""}')))[0].startswith("entity-decision:sha256:")


def test_reversals(spark):
    d = spark.createDataFrame([("1", "merge", None), ("2", "reversal", "1"), ("3", "split", None)], "decision_id string, kind string, reversed_id string")
    assert [r.decision_id for r in history.active(d).collect()] == ["3"]
    r = spark.createDataFrame([("9",), ("2",), ("3",)], "reversed_id string")
    assert {(x.reversed_id, x.error) for x in history.reversal_error(r, d).collect()} == {("9", "missing"), ("2", "kind"), ("3", None)}


def test_cut_points(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "s long, o long")
    got = {(r.kind, r.a, r.b) for r in analytics.cut_points(e).collect()}
    assert got == {("bridge", 3, 4), ("bridge", 4, 5), ("bridge", 7, 8), ("articulation", 3, None), ("articulation", 4, None)}


# ---- stores, acquisition, reasoning, streams


def test_store_is_content_addressed(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([('{"reasoning_mode": "exact-replay"}',), ('{ "reasoning_mode":"exact-replay"}',)], "payload string")
    names = artefacts.write(rows, path, "configuration").collect()
    assert [r.reference.identity for r in names] == ["sha256:642a0ca2ac943fb20038a8dcb4f2bcf4237ccd00450256cb6c744b14515f1d5e"]
    artefacts.write(rows, path, "configuration")
    held = artefacts.read(spark, path, "configuration")
    assert held.count() == 1 and artefacts.require_valid(artefacts.verified(held)).count() == 1
    with pytest.raises(artefacts.IntegrityError, match="does not match"):
        artefacts.require_valid(artefacts.verified(held.withColumn("payload", F.lit("{}"))))
    with pytest.raises(ValueError):
        artefacts.write(rows, path, "a/b")
    artefacts.set_pointer(spark, str(tmp_path / "current"), "sha256:x")
    artefacts.set_pointer(spark, str(tmp_path / "current"), "sha256:y")
    assert artefacts.pointer(spark, str(tmp_path / "current")) == "sha256:y"


BODIES = {p: json.dumps({"base_path": p, "content_id": p[1:], "locale": "en", "updated_at": "2026-01-01", "title": p}).encode() for p in ("/alpha", "/zebra")}


def test_acquisition_then_verified_reading(spark, tmp_path):
    found = {"total": 2, "results": [{"link": "/zebra?x"}, {"link": "/alpha"}]}
    path, bodies = str(tmp_path / "corpus"), dict(BODIES)
    assert corpus.acquire(spark, path, "org", lambda url: bodies[url[3:]], lambda start, n: found, "api") == 2
    rows = corpus.read_corpus(spark, path).orderBy("sequence").collect()
    assert [(r.sequence, r.base_path, r.diagnostic) for r in rows] == [(0, "/alpha", None), (1, "/zebra", None)]
    with pytest.raises(FileExistsError):
        corpus.acquire(spark, path, "org", None, None, "api")
    (tmp_path / "corpus/source-documents/00001.json").write_bytes(b"{}")
    assert [r.diagnostic for r in corpus.read_corpus(spark, path).orderBy("sequence").collect()] == [None, "sha256"]


def test_failed_acquisition_leaves_a_report(spark, tmp_path):
    bodies = {"/alpha": BODIES["/alpha"]}
    found = {"total": 2, "results": [{"link": "/alpha"}, {"link": "/zebra"}]}
    with pytest.raises(corpus.AcquisitionError):
        corpus.acquire(spark, str(tmp_path / "c"), "org", lambda url: bodies[url], lambda start, n: found, "")
    report = json.loads((tmp_path / "c/acquisition-failure.json").read_text())
    assert report["status"] == "incomplete" and [f["source_path"] for f in report["failures"]] == ["/zebra"] and not (tmp_path / "c/manifest.json").exists()


def test_enumeration_refuses():
    page = lambda *links, total=2: lambda start, n: {"total": total, "results": [{"link": x} for x in links[start : start + n]]}
    assert corpus.enumerate_paths(page("/b", "/a", "/c", total=3), 2) == ["/a", "/b"]
    for bad in (page("/a"), page("/a", "/a"), page("/a", "https://x/y"), page("/a", None), lambda start, n: {"total": 2 + start, "results": [{"link": f"/{start}"}]}):
        with pytest.raises(corpus.AcquisitionError):
            corpus.enumerate_paths(bad, 10, page=1)


def test_retries_are_recorded(spark):
    def model(request):
        if "down" in request:
            raise ConnectionError("down")
        return "[]" if "bad" in request else '{"ok": 1}'

    def ok(value):
        if "ok" not in value:
            raise ValueError("no")

    rows = {r.request: r for r in reasoning.run(spark.createDataFrame([("down",), ("bad",), ("fine",)], "payload string"), "s", model, ok, 2).collect()}
    assert (rows["down"].failure, rows["bad"].failure, rows["fine"].failure) == ("invocation", "validation", None)
    assert (rows["down"].attempts, rows["fine"].attempts) == (2, 1)
    with pytest.raises(ValueError):
        reasoning.check_configuration({"headers": {"Authorization": "x"}})
    with pytest.raises(ValueError):
        reasoning.check_configuration({"speed": 1})
    assert reasoning.check_configuration({"top_p": 1, "seed": 2}) == '{"seed":2,"top_p":1}'


def test_a_stream_ingests_each_version_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "id string, body string")
    rows.write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        ingest(stream, "id", "body", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        rows.write.mode("append").parquet(source)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_workflow(spark):
    flow = Workflow().add("double", lambda r: r["n"].selectExpr("id * 2 AS id")).add("sum", lambda r: r["double"].groupBy().sum("id"), "double")
    assert flow.run(n=spark.range(4))["sum"].first()[0] == 12
    with pytest.raises(ValueError):
        flow.add("x", None, "nothing")
