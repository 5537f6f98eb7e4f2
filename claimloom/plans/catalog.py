"""Named queries over the driver tables, each with its SQL. They put rows of those tables into the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import canonical_value
from ..functions.text import non_blank, percent_encoded, plain_text, sha_identity
from ..operators import analytics, canonical, claims, decisions, extraction, history, ontology, quads, records, requests, resolution, temporal
from ..sources import artefacts, corpus, reasoning

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
V = quads.Vocabulary()


def query(sql: str | None = None):
    def note(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return note


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS identity FROM documents")
def artefact_sha256(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", sha_identity(F.col("text")).alias("identity"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def artefact_dedupe(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""SELECT n_nationkey, sha256('{"payload":{"name":' || to_json(n_name) || ',"region":' || n_regionkey || '},"schema_version":"1"}') AS sha256 FROM nation""")
def artefact_envelope(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")))
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.sha2(artefacts.envelope(payload), 256).alias("sha256"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'identity' WHEN doc_id % 3 = 1 THEN 'kind' END AS error FROM documents""")
def reference_errors(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    identity = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise(sha_identity(F.col("text")))
    ref = F.struct(identity.alias("identity"), F.when(F.col("doc_id") % 3 == 1, "a/b").otherwise("claim").alias("kind"), F.lit("1").alias("schema_version"))
    return d.select("doc_id", artefacts.reference_error(ref).alias("error"))


@query("SELECT doc_id, v, sha256(v) AS index_key FROM (SELECT doc_id, 'content_id:' || doc_id || ':sha256:' || sha256(text) AS v FROM documents)")
def source_version_identity(spark, sf_dir):
    v = F.concat(F.lit("content_id:"), F.col("doc_id").cast("string"), F.lit(":sha256:"), F.sha2("text", 256))
    return _t(spark, sf_dir, "documents").select("doc_id", v.alias("v"), F.sha2(v, 256).alias("index_key"))


@query("SELECT page_id, url, host, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS sequence FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)")
def manifest_sequence(spark, sf_dir):
    """Pages of one url stand in the order of their ids; the SQL leaves that open."""
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    return rows.withColumn("sequence", (F.row_number().over(Window.partitionBy("host").orderBy("url", "page_id")) - 1).cast("long"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1), '[?#].*$', '') END AS path FROM pages""")
def link_validation(spark, sf_dir):
    link = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)$", 1))
    return _t(spark, sf_dir, "pages").select("page_id", corpus.source_path(link).alias("path"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'path' WHEN doc_id % 7 = 0 THEN 'sha256' WHEN doc_id % 5 = 0 THEN 'content_id' WHEN doc_id % 3 = 0 THEN 'source_version' END AS diagnostic FROM documents""")
def manifest_verify_mismatch(spark, sf_dir):
    i = F.col("doc_id")
    body = F.encode(F.to_json(F.struct(i.cast("string").alias("content_id"), F.col("text").alias("body"))), "UTF-8")
    sha = F.when(i % 7 == 0, F.sha2(F.concat(body, F.lit(b" ")), 256)).otherwise(F.sha2(body, 256))
    own = F.when(i % 5 == 0, F.lit("x")).otherwise(i.cast("string"))
    entry = {
        "source_json": F.when(i % 11 == 0, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat(F.lit("source-documents/"), i.cast("string"))),
        "source_json_sha256": sha, "content_id": own,
        "source_version": F.when(i % 3 == 0, "v").otherwise(F.concat(F.lit("content_id:"), own, F.lit(":sha256:"), sha)),
    }
    return _t(spark, sf_dir, "documents").select("doc_id", corpus.manifest_error(entry, body).alias("diagnostic"))




def _nested(d: DataFrame) -> DataFrame:
    inner = F.struct(F.array(F.col("source"), F.concat(F.col("source"), F.lit("/x"))).alias("b/c"), F.col("lang").alias("a~b"))
    return d.select("doc_id", F.to_json(F.struct(F.col("lang").alias("title"), inner.alias("details"), F.col("n_chars").alias("size"))).alias("body"))


@query(
    """SELECT doc_id, pointer, value FROM documents, LATERAL (VALUES ('/title', lang), ('/details/b~1c/0', source), ('/details/b~1c/1', source || '/x'), ('/details/a~0b', lang)) AS t(pointer, value)"""
)
def json_leaf_passages(spark, sf_dir):
    return canonical.leaf_passages(_nested(_t(spark, sf_dir, "documents")), "doc_id", "body").select("doc_id", "pointer", "value")


@query(
    """SELECT doc_id, sha256('/details/a~0b:' || chr(10) || lang || chr(10) || chr(10) || '/details/b~1c/0:' || chr(10) || source || chr(10) || chr(10) || '/details/b~1c/1:' || chr(10) || source || '/x' || chr(10) || chr(10) || '/title:' || chr(10) || lang || chr(10)) AS canonical_sha256 FROM documents"""
)
def canonical_document_sha(spark, sf_dir):
    return canonical.canonical_documents(_nested(_t(spark, sf_dir, "documents")), "doc_id", "body").select("doc_id", "canonical_sha256")


_PLAIN_SQL = r"trim(array_to_string(list_transform(string_split(nfc_normalize(text), chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), chr(10)), ' ' || chr(10))"


@query(f"SELECT doc_id, sha256({_PLAIN_SQL}) AS sha256, length({_PLAIN_SQL}) AS n FROM documents")
def canonical_plain_text(spark, sf_dir):
    """Plain text alone, as Columns; documents hold no markup."""
    from ..functions.text import nfc

    text = plain_text(nfc(F.col("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("sha256"), F.length(text).cast("long").alias("n"))


@query()
def canonical_html(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", canonical_value(F.col("html")).alias("canonical_text"))


def _sentence_anchor() -> Column:
    return canonical.build_anchor(F.col("text"), F.lit(0), F.position(F.lit("."), F.col("text")))


_ANCHOR_SQL = """WITH d AS (SELECT doc_id, text, strpos(text, '.') AS e FROM documents WHERE strpos(text, '.') > 0)
SELECT doc_id, 0 AS start_offset, e::INT AS end_offset, 0 AS start_line, (length(text[1:e - 1]) - length(replace(text[1:e - 1], chr(10), '')))::INT AS end_line,
  text[1:e] AS selected_text, '' AS prefix, text[e + 1:e + 32] AS suffix FROM d"""


@query(_ANCHOR_SQL)
def evidence_anchor_build(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where(F.position(F.lit("."), F.col("text")) > 0)
    return d.select("doc_id", _sentence_anchor().alias("a")).select("doc_id", "a.*").select("doc_id", "start_offset", "end_offset", "start_line", "end_line", "selected_text", "prefix", "suffix")


@query(
    """WITH d AS (SELECT doc_id, text, text[1:strpos(text, '.')] AS q FROM documents WHERE strpos(text, '.') > 0),
u AS (SELECT *, strpos(text[2:], q) = 0 AS once, length(text) AS n FROM d)
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'selected_text' WHEN 1 THEN 'offset' WHEN 2 THEN 'offset'
  WHEN 3 THEN CASE WHEN length(q) < 2 THEN 'offset' WHEN once THEN 'start_offset' ELSE 'selected_text' END
  WHEN 4 THEN 'prefix' WHEN 5 THEN 'suffix' WHEN 6 THEN 'start_line' END AS error_field FROM u"""
)
def evidence_anchor_validate(spark, sf_dir):
    """Anchors of first sentences, each spoilt in one field by doc_id % 8; 7 is left valid."""
    d = _t(spark, sf_dir, "documents").where(F.position(F.lit("."), F.col("text")) > 0).select("doc_id", "text", _sentence_anchor().alias("a"))
    k = F.col("doc_id") % 8
    spoil = {"selected_text": (0, F.lit("")), "start_offset": (3, F.lit(1)), "prefix": (4, F.lit("x")), "suffix": (5, F.concat(F.col("a.suffix"), F.lit("\u0001"))), "start_line": (6, F.lit(9))}
    fields = [F.when(k == spoil[f][0], spoil[f][1]).otherwise(F.col(f"a.{f}")).alias(f) for f in spoil]
    end = F.when(k == 1, F.length("text") + 1).when(k == 2, 0).otherwise(F.col("a.end_offset")).alias("end_offset")
    bad = F.struct(*fields, end, F.col("a.end_line").alias("end_line"))
    return d.select("doc_id", canonical.anchor_error(bad, F.col("text")).alias("error_field"))


@query("SELECT doc_id, strpos(text[2:], text[1:strpos(text, '.')]) = 0 AS once FROM documents WHERE strpos(text, '.') > 0")
def repeated_quote_unique(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where(F.position(F.lit("."), F.col("text")) > 0)
    quote = F.substring("text", F.lit(1), F.position(F.lit("."), F.col("text")))
    return d.select("doc_id", (F.position(quote, F.col("text"), F.lit(2)) == 0).alias("once"))


_TYPE = quads.RDF + "type"


@query(
    f"""WITH n AS (SELECT n_nationkey, '{{"name":' || to_json(n_name) || ',"region":' || n_regionkey || '}}' AS body, n_name, n_regionkey FROM nation),
d AS (SELECT *, '{V("source-document/")}' || n_nationkey || '/' || sha256(body) AS node FROM n)
SELECT * FROM (
SELECT '{V("graph/source-documents")}' AS g, node AS s, '{_TYPE}' AS p, '{V("SourceDocument")}' AS o, 'iri' AS o_kind, NULL AS o_datatype FROM d
UNION ALL SELECT '{V("graph/source-documents")}', node, '{V("sourceJson")}', body, 'literal', '{quads.RDF}JSON' FROM d
UNION ALL SELECT '{V("graph/source-documents")}', node, '{V("sourceVersion")}', 'content_id:' || n_nationkey || ':sha256:' || sha256(body), 'literal', NULL FROM d
UNION ALL SELECT '{V("graph/source-documents")}', node || '/assertion/' || k, p, CASE p WHEN '{_TYPE}' THEN '{V("SourceAssertion")}' WHEN '{V("about")}' THEN node WHEN '{V("sourceKey")}' THEN k ELSE CASE k WHEN 'name' THEN to_json(n_name)::VARCHAR ELSE n_regionkey::VARCHAR END END,
  CASE WHEN p IN ('{_TYPE}', '{V("about")}') THEN 'iri' ELSE 'literal' END, CASE WHEN p = '{V("sourceValue")}' THEN '{quads.RDF}JSON' END
  FROM d, (VALUES ('name'), ('region')) AS ks(k), (VALUES ('{_TYPE}'), ('{V("about")}'), ('{V("sourceKey")}'), ('{V("sourceValue")}')) AS ps(p))"""
)
def source_quads(spark, sf_dir):
    return _nation_quads(spark, sf_dir)


def _nation_quads(spark, sf_dir) -> DataFrame:
    body = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    rows = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), body.alias("body"), F.sha2(body, 256).alias("sha"))
    return quads.source_quads(rows, "id", "body", "sha")


@query("SELECT p_partkey, url_encode(p_name || ' /~*+é') AS encoded FROM part")
def quad_encode_iri(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", percent_encoded(F.concat("p_name", F.lit(" /~*+é"))).alias("encoded"))


def _order_quads(spark, sf_dir) -> DataFrame:
    """Customers and orders as quads of two graphs."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    customer = F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string"))
    order = F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string"))
    own = quads.quads_of(c, quads.quad("urn:g:customers", customer, _TYPE, F.lit("urn:Customer"), "iri"), quads.quad("urn:g:customers", customer, "urn:segment", F.col("c_mktsegment")))
    made = quads.quads_of(o, quads.quad("urn:g:orders", order, "urn:by", F.concat(F.lit("urn:customer:"), F.col("o_custkey").cast("string")), "iri"), quads.quad("urn:g:orders", order, "urn:status", F.col("o_orderstatus")))
    return own.unionByName(made)


@query(
    """SELECT DISTINCT 'urn:order:' || o_orderkey AS "order", 'urn:customer:' || c_custkey AS customer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'"""
)
def bgp_select(spark, sf_dir):
    from .sparql import select

    return select(
        _order_quads(spark, sf_dir),
        """PREFIX u: <urn:> SELECT DISTINCT ?order ?customer WHERE {
             GRAPH <urn:g:orders> { ?order u:by ?customer ; u:status "F" . }
             GRAPH ?where { ?customer a u:Customer ; u:segment "BUILDING" } }""",
    )


@query("SELECT true AS customers, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'no such status') AS nothing")
def bgp_ask_term(spark, sf_dir):
    from .sparql import ask

    q = _order_quads(spark, sf_dir)
    term = ask(q, "ASK { GRAPH ?g { { <urn:Customer> ?p ?o } UNION { ?s <urn:Customer> ?o } UNION { ?s ?p <urn:Customer> } } }")
    return spark.createDataFrame([(term, ask(q, 'ASK { ?s <urn:status> "no such status" }'))], "customers boolean, nothing boolean")


@query(
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y') || '-13' ELSE 'soon' END AS expression FROM orders),
s AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN TRY_CAST(expression || '-01-01' AS DATE) WHEN 1 THEN TRY_CAST(expression || '-01' AS DATE) WHEN 2 THEN TRY_CAST(expression AS DATE) END AS low FROM o)
SELECT o_orderkey, expression, strftime(low, '%Y-%m-%d') AS lower_bound, strftime(CASE o_orderkey % 5 WHEN 0 THEN low + INTERVAL 1 YEAR WHEN 1 THEN low + INTERVAL 1 MONTH WHEN 2 THEN low + INTERVAL 1 DAY END, '%Y-%m-%d') AS upper_bound FROM s"""
)
def calendar_year_month_day(spark, sf_dir):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, _iso(d)).when(k == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-13"))).otherwise("soon")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", text.alias("expression"))
    return rows.withColumn("c", temporal.resolve_calendar(F.col("expression"))).select("o_orderkey", "expression", "c.lower_bound", "c.upper_bound")


@query(
    """SELECT o_orderkey, (year(o_orderdate) + CASE WHEN month(o_orderdate) < 4 THEN 0 ELSE 1 END)::VARCHAR || '-04-01' AS lower_bound, (year(o_orderdate) + CASE WHEN month(o_orderdate) < 4 THEN 0 ELSE 1 END)::VARCHAR || '-05-01' AS upper_bound FROM orders"""
)
def next_april(spark, sf_dir):
    reference = F.concat(_iso("o_orderdate"), F.lit("T23:30:00-01:00"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", temporal.resolve_calendar(F.lit("next April"), reference).alias("c"))
    return rows.select("o_orderkey", "c.lower_bound", "c.upper_bound")


def _spans(spark, sf_dir) -> DataFrame:
    """Each event as a constraint of days: from its day, for value days; by event_id % 4 one side is open."""
    e = _t(spark, sf_dir, "events")
    low, high = _iso("ts"), _iso(F.date_add(F.to_date("ts"), F.floor(F.col("value") % 5).cast("int")))
    k = F.col("event_id") % 4
    c = temporal.constraint(F.when(k != 1, low), F.when(k != 2, high), F.lit(True), (k == 2) | (k == 3))
    return e.select("event_id", "user_id", F.to_date("ts").alias("day"), c.alias("c"))


_SPANS_SQL = """e AS (SELECT event_id, user_id, ts::DATE AS day, CASE WHEN event_id % 4 <> 1 THEN ts::DATE END AS lo, CASE WHEN event_id % 4 <> 2 THEN ts::DATE + floor(value % 5)::INT END AS hi, event_id % 4 IN (2, 3) AS hi_inc FROM events)"""


@query(
    f"""WITH {_SPANS_SQL} SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id
WHERE (a.lo IS NULL OR b.hi IS NULL OR a.lo < b.hi OR (a.lo = b.hi AND b.hi_inc)) AND (b.lo IS NULL OR a.hi IS NULL OR b.lo < a.hi OR (b.lo = a.hi AND a.hi_inc))"""
)
def interval_overlap(spark, sf_dir):
    e = _spans(spark, sf_dir).select("event_id", "user_id", temporal.ends(F.col("c")).alias("ends"))
    a, b = e.alias("a"), e.alias("b")
    near = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_id") < F.col("b.event_id")) & temporal.meet(F.col("a.ends"), F.col("b.ends"))
    return a.join(b, near).select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query(
    f"""WITH {_SPANS_SQL} SELECT event_id, coalesce(lo >= day - 1 AND hi <= day + 2 AND NOT (lo = day - 1 AND hi = day + 2 AND NOT hi_inc), false) AS stronger FROM e"""
)
def interval_strictly_stronger(spark, sf_dir):
    wide = temporal.during(_iso(F.date_sub("day", 1)), _iso(F.date_add("day", 2)))
    return _spans(spark, sf_dir).select("event_id", temporal.strictly_stronger(F.col("c"), wide).alias("stronger"))


@query(f"WITH {_SPANS_SQL} SELECT event_id, CASE WHEN lo = hi AND NOT hi_inc THEN 'empty' WHEN event_id % 4 = 1 AND hi IS NULL THEN 'bounds' END AS error FROM e")
def constraint_invalid(spark, sf_dir):
    return _spans(spark, sf_dir).select("event_id", temporal.constraint_error(F.col("c")).alias("error"))


def _flags(spark, sf_dir) -> DataFrame:
    item = F.concat_ws(":", F.lit("urn:line"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    day = F.to_date("l_shipdate")
    return _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), item.alias("subject"), F.lit("urn:flag").alias("predicate"),
        F.col("l_returnflag").alias("object"), F.lit("literal").alias("object_kind"), temporal.during(_iso(day), _iso(F.date_add(day, 30))).alias("time"), F.col("l_linestatus").alias("status"),
    )


_FLAGS_SQL = """l AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS claim_id, concat_ws(':', 'urn:line', l_orderkey, l_linenumber) AS subject, l_returnflag AS object, l_shipdate::DATE AS lo, l_shipdate::DATE + 30 AS hi, l_linestatus AS status FROM lineitem)"""


@query(f"WITH {_FLAGS_SQL} SELECT p.claim_id, a.claim_id AS accepted_claim_id, p.subject, p.object, a.object AS accepted_object FROM l p JOIN l a ON p.subject = a.subject AND p.object <> a.object")
def assertion_conflict(spark, sf_dir):
    rows = _flags(spark, sf_dir).withColumn("time", F.lit(None).cast(temporal.DDL))
    return claims.conflicts(rows, rows).drop("predicate")


@query(f"WITH {_FLAGS_SQL} SELECT p.claim_id, a.claim_id AS accepted_claim_id, p.subject, p.object, a.object AS accepted_object FROM l p JOIN l a ON p.subject = a.subject AND p.object <> a.object AND p.lo < a.hi AND a.lo < p.hi")
def conflict_temporal(spark, sf_dir):
    rows = _flags(spark, sf_dir)
    return claims.conflicts(rows, rows).drop("predicate")


@query("SELECT event_id, 'urn:' || event_type AS predicate FROM events WHERE event_type NOT IN ('click', 'view')")
def ontology_gap_predicates(spark, sf_dir):
    known = spark.createDataFrame([("urn:click", "urn:property"), ("urn:other", "urn:view")], "s string, o string")
    rows = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("urn:"), "event_type").alias("predicate"))
    return claims.unknown_predicates(rows, known)


@query("SELECT 'urn:customer:' || c_custkey AS focus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 10")
def shacl_min_count(spark, sf_dir):
    from ..operators.shacl import read_shapes, validate

    shapes = read_shapes("""@prefix sh: <http://www.w3.org/ns/shacl#> . <urn:shape> a sh:NodeShape ; sh:targetClass <urn:Customer> ; sh:property [ sh:path <urn:made> ; sh:minCount 10 ] .""")
    q = _order_quads(spark, sf_dir)
    made = q.where("p = 'urn:by'").select("g", F.col("o").alias("s"), F.lit("urn:made").alias("p"), F.col("s").alias("o"), "o_kind", "o_datatype")
    return validate(q.unionByName(made), shapes).select("focus")


@query("SELECT DISTINCT 'urn:nation:' || n_nationkey AS focus FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def shacl_class(spark, sf_dir):
    from ..operators.shacl import read_shapes, validate

    shapes = read_shapes("""PREFIX sh: <http://www.w3.org/ns/shacl#> <urn:s> a sh:NodeShape ; sh:targetClass <urn:Nation> ; sh:property [ sh:path <urn:in> ; sh:class <urn:Region> ; sh:nodeKind sh:IRI ] .""")
    iri = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string"))
    n = quads.quads_of(_t(spark, sf_dir, "nation"), quads.quad("g", iri("nation", "n_nationkey"), _TYPE, F.lit("urn:Nation"), "iri"), quads.quad("g", iri("nation", "n_nationkey"), "urn:in", iri("region", "n_regionkey"), "iri"))
    r = quads.quads_of(_t(spark, sf_dir, "region").where("r_regionkey < 3"), quads.quad("g", iri("region", "r_regionkey"), _TYPE, F.lit("urn:Region"), "iri"))
    return validate(n.unionByName(r), shapes).select("focus")


@query(
    """SELECT doc_id, CASE WHEN quality = 0 THEN 'out_of_scope' WHEN doc_id % 3 = 0 THEN 'ontology_gap' WHEN doc_id % 5 = 0 THEN 'constraint_violation' WHEN toxic = 1 THEN 'conflict' ELSE 'accepted' END AS disposition,
  CASE WHEN quality = 0 THEN 'a' WHEN doc_id % 3 = 0 THEN 'The Claim awaits Ontology review.' WHEN doc_id % 5 = 0 THEN 'The Claim cannot enter accepted knowledge.' WHEN toxic = 1 THEN 'The Claim conflicts with accepted knowledge.' ELSE 'a' END AS acceptance,
  CASE WHEN quality = 0 OR doc_id % 3 = 0 THEN 'c' WHEN doc_id % 5 = 0 THEN CASE WHEN toxic = 1 THEN 'clash' ELSE 'No conflict was detected against accepted knowledge.' END WHEN toxic = 1 THEN 'clash' ELSE 'c' END AS conflict FROM labels"""
)
def claim_disposition_apply(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("out_of_scope").alias("disposition"), F.lit("m").alias("mapping"), F.lit("v").alias("validation"), F.lit("c").alias("conflict"), F.lit("a").alias("acceptance"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("gap"))).alias("gaps"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("broken"))).alias("violations"), F.when(F.col("toxic") == 1, F.array(F.lit("clash"))).alias("clashes"),
        F.array(F.lit("x")).alias("assertions"),
    )
    return claims.apply_assessment(rows).select("doc_id", "disposition", "acceptance", "conflict")


def _mappings(spark, sf_dir) -> DataFrame:
    i = F.col("doc_id").cast("string")
    one = F.struct(F.concat(F.lit("urn:d:"), i).alias("subject"), F.lit("urn:toxic").alias("predicate"), F.col("toxic").cast("string").alias("object"), F.lit("literal").alias("object_kind"))
    ok = F.col("quality") == 1
    return _t(spark, sf_dir, "labels").select(
        i.alias("claim_id"), F.lit("said").alias("assertion"), F.lit(1.0).alias("confidence"), F.lit("why").alias("rationale"), F.lit('{"event": null}').alias("times_json"), F.array(F.lit('{"a": 1}')).alias("evidence_json"),
        F.when(ok, "accepted").otherwise("rejected").alias("disposition"), *[F.lit(c[0]).alias(c) for c in quads.REASONS.values()], F.when(ok, F.array(one)).otherwise(F.array().cast("array<struct<subject:string,predicate:string,object:string,object_kind:string>>")).alias("assertions"),
    )


@query(
    f"""WITH m AS (SELECT doc_id, toxic, quality, '{V("claim/")}' || doc_id AS c FROM labels), a AS (SELECT * FROM m WHERE quality = 1)
SELECT '{V("graph/claims")}' AS g, c AS s, p, o, k AS o_kind FROM m, (VALUES ('{_TYPE}', '{V("Claim")}', 'iri'), ('{V("claimAssertion")}', 'said', 'literal'), ('{V("claimConfidence")}', '1.0', 'literal'), ('{V("claimRationale")}', 'why', 'literal'), ('{V("claimTime")}', '{{"event":null}}', 'literal'),
  ('{V("mappingReason")}', 'm', 'literal'), ('{V("validationReason")}', 'v', 'literal'), ('{V("conflictReason")}', 'c', 'literal'), ('{V("scopeReason")}', 's', 'literal'), ('{V("acceptanceReason")}', 'a', 'literal'), ('{V("evidence")}', '{{"a":1}}', 'literal')) AS t(p, o, k)
UNION ALL SELECT '{V("graph/claims")}', c, '{V("disposition")}', CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END, 'literal' FROM m
UNION ALL SELECT '{V("graph/accepted-knowledge")}', 'urn:d:' || doc_id, 'urn:toxic', toxic::VARCHAR, 'literal' FROM a
UNION ALL SELECT '{V("graph/claims")}', c, '{V("projectsAssertion")}', c || '/assertion/0', 'iri' FROM a
UNION ALL SELECT '{V("graph/claims")}', c || '/assertion/0', '{_TYPE}', '{quads.RDF}Statement', 'iri' FROM a
UNION ALL SELECT '{V("graph/claims")}', c || '/assertion/0', '{quads.RDF}subject', 'urn:d:' || doc_id, 'iri' FROM a
UNION ALL SELECT '{V("graph/claims")}', c || '/assertion/0', '{quads.RDF}predicate', 'urn:toxic', 'iri' FROM a
UNION ALL SELECT '{V("graph/claims")}', c || '/assertion/0', '{quads.RDF}object', toxic::VARCHAR, 'literal' FROM a"""
)
def claim_projection_quads(spark, sf_dir):
    return quads.claim_quads(_mappings(spark, sf_dir)).drop("o_datatype")


@query("SELECT doc_id::VARCHAR AS claim_id, CASE WHEN doc_id % 7 = 0 THEN 'evidence' WHEN (quality = 1) <> (doc_id % 2 = 0) THEN 'assertions' END AS error FROM labels")
def accepted_requires_assertion(spark, sf_dir):
    m = _mappings(spark, sf_dir)
    i = F.col("claim_id").cast("long")
    one = F.array(F.struct(F.lit("urn:a").alias("subject"), F.lit("urn:b").alias("predicate"), F.lit("x").alias("object"), F.lit("literal").alias("object_kind")))
    held = F.when(i % 2 == 0, one).otherwise(F.slice(one, 1, 0))
    return m.select("claim_id", claims.mapping_error(F.col("disposition"), held, F.when(i % 7 == 0, F.slice("evidence_json", 1, 0)).otherwise(F.col("evidence_json"))).alias("error"))


def _turns(spark, sf_dir) -> DataFrame:
    i = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role").dropDuplicates(["conv_id", "turn"])
    first = t.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    kind = F.when(F.col("turn") % 3 == 2, "reversal").when(F.col("turn") % 3 == 1, "split").otherwise("merge")
    return t.join(first, "conv_id").select(i(F.col("turn")).alias("decision_id"), F.when(F.col("turn") > F.col("t0"), i(F.col("turn") - 1)).alias("previous_id"), kind.alias("kind"), F.when(F.col("turn") % 3 == 2, i(F.col("turn") - 1)).alias("reversed_id"))


@query(
    """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), f AS (SELECT conv_id, min(turn) AS t0 FROM t GROUP BY 1),
c AS (SELECT t.*, t0, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn) - 1 AS r FROM t JOIN f USING (conv_id))
SELECT conv_id || ':' || turn AS decision_id, CASE WHEN turn - t0 = r THEN r::INT END AS step, CASE WHEN turn - t0 <> r THEN 'missing' END AS diagnostic FROM c"""
)
def history_walk(spark, sf_dir):
    return history.walk(_turns(spark, sf_dir)).select("decision_id", "step", "diagnostic")


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id || ':' || turn AS decision_id FROM t WHERE turn % 3 IN (0, 1) AND (conv_id, turn) NOT IN (SELECT (conv_id, turn - 1) FROM t WHERE turn % 3 = 2)""")
def history_reversal_active(spark, sf_dir):
    return history.active(_turns(spark, sf_dir)).select("decision_id")


@query("SELECT DISTINCT 's' || s_suppkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey ELSE t END AS target FROM supplier, (VALUES ('x'), ('y')) AS v(t)")
def merge_split_map(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    merges = s.where("s_suppkey % 2 = 0").groupBy("s_nationkey").agg(F.collect_set(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("sources")).select(F.concat(F.lit("m"), F.col("s_nationkey").cast("string")).alias("decision_id"), F.lit("merge").alias("kind"), F.lit(None).cast("string").alias("reversed_id"), "sources", F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("targets"))
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    splits = s.where("s_suppkey % 2 = 1").select(name.alias("decision_id"), F.lit("split").alias("kind"), F.lit(None).cast("string").alias("reversed_id"), F.array(name).alias("sources"), F.array(F.lit("x"), F.lit("y")).alias("targets"))
    return history.identity_map(merges.unionByName(splits))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0) GROUP BY text")
def extract_once(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("source_version")).agg(F.min("doc_id").alias("doc_id"))
    done = _t(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("source_version"))
    return reasoning.extract_once(d, done, "source_version").select("doc_id")


@query(
    """WITH r AS (SELECT u.text AS q, min_by(a.text, (u.conv_id, u.turn)) AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.conv_id % 2 = 0 GROUP BY 1)
SELECT u.conv_id, u.turn, r.answer AS output FROM conversations u LEFT JOIN r ON u.text = r.q WHERE u.role = 'user'"""
)
def replay_join(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    packed = F.to_json(F.struct("text"))
    asked = c.where("role = 'user'").select("conv_id", "turn", packed.alias("payload"))
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("structured_output"))
    recorded = asked.where("conv_id % 2 = 0").join(answers, ["conv_id", "turn"]).select(F.lit("chat").alias("stage"), F.col("payload").alias("structured_input"), "structured_output", F.struct("conv_id", "turn").alias("sequence"))
    return reasoning.replay(asked, recorded, "chat").select("conv_id", "turn", "output")


@query(
    """SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') >= 5 THEN 'invocation' WHEN count(*) FILTER (event_type IN ('error', 'click')) >= 5 THEN 'validation' ELSE 'completed' END AS outcome FROM events GROUP BY 1"""
)
def retry_outcome(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "provider").when(F.col("event_type") == "click", "invalid")
    return reasoning.retry_outcome(_t(spark, sf_dir, "events").select("user_id", kind.alias("failed")), "user_id", "failed", 5)


@query("SELECT n_regionkey, CASE WHEN count(*) > 4 THEN 'candidates' END AS error FROM nation GROUP BY 1")
def entity_candidates_bounded(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("c"))
    return rows.select("n_regionkey", history.context_error(F.col("c"), F.lit(4), F.array(F.lit(1))).alias("error"))


@query(
    """WITH s AS (SELECT p_type AS term, max_by(p_size % 2 = 0, p_partkey) AS suitable FROM part WHERE p_size < 25 GROUP BY 1),
c AS (SELECT p_brand AS term, CASE WHEN p_brand < 'Brand#3' THEN 'local_invention' ELSE 'external_reuse' END AS kind, list(DISTINCT p_type) AS external FROM part GROUP BY 1),
x AS (SELECT c.term, kind, coalesce(bool_or(s.term IS NULL), false) AS lacking, coalesce(bool_or(suitable), false) AS fits FROM (SELECT term, kind, unnest(external) AS e FROM c) c LEFT JOIN s ON s.term = c.e GROUP BY 1, 2)
SELECT term, 'Ontology change ''' || term || ''' ' || d AS diagnostic FROM x, LATERAL (SELECT unnest([CASE WHEN lacking THEN 'lacks recorded external-term research.' END, CASE WHEN kind = 'local_invention' AND fits THEN 'invents locally despite a suitable external term.' END, CASE WHEN kind = 'external_reuse' AND NOT fits THEN 'does not identify a suitable reused term.' END, CASE WHEN kind = 'external_reuse' THEN 'must reuse an evidenced external term.' END]) AS d) WHERE d IS NOT NULL"""
)
def research_diagnostics(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    assessed = p.where("p_size < 25").select(F.col("p_type").alias("term"), (F.col("p_size") % 2 == 0).alias("suitable"), F.col("p_partkey").alias("ord"))
    changes = p.groupBy(F.col("p_brand").alias("term")).agg(F.collect_set("p_type").alias("external_terms")).withColumn("kind", F.when(F.col("term") < "Brand#3", "local_invention").otherwise("external_reuse"))
    return ontology.research_diagnostics(changes, assessed).select("term", "diagnostic")


@query(
    """WITH n AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY day) AS share FROM n)
SELECT day, sum(n)::BIGINT AS rows, count(*) AS clusters, round(-sum(share * ln(share)), 6) AS entropy, max(n) AS largest, round(max(share), 6) AS largest_share FROM s GROUP BY 1"""
)
def gap_entropy(spark, sf_dir):
    return analytics.cluster_measures(_t(spark, sf_dir, "events").withColumn("day", _iso("ts")), "day", "event_type")


@query("SELECT toxic, count(*) FILTER (quality = 0) AS \"0\", count(*) FILTER (quality = 1) AS \"1\" FROM labels GROUP BY 1")
def disposition_counts(spark, sf_dir):
    return analytics.disposition_counts(_t(spark, sf_dir, "labels"), "toxic", "quality", [0, 1])


def _supplies(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("o"))


@query(
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS o FROM lineitem) SELECT node, sum(a)::BIGINT AS out_degree, sum(b)::BIGINT AS in_degree FROM (SELECT s AS node, 1 AS a, 0 AS b FROM e UNION ALL SELECT o, 0, 1 FROM e) GROUP BY 1"""
)
def degree_stats(spark, sf_dir):
    return analytics.degrees(_supplies(spark, sf_dir).distinct())


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM d UNION SELECT d.b, r.seen FROM r JOIN d ON r.node = d.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1"""
)
def connected_components(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return analytics.components(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("o")))


_RANK_STEP = "r{k} AS (SELECT node, 0.15 / c + 0.85 / c * (1 - (SELECT coalesce(sum(x), 0) FROM (SELECT sum(r / d) AS x FROM l JOIN r{j} ON l.s = r{j}.node GROUP BY l.o))) + 0.85 * coalesce((SELECT sum(r / d) FROM l JOIN r{j} q ON l.s = q.node WHERE l.o = n.node), 0) AS r FROM n, t)"


@query(
    "WITH e AS (SELECT DISTINCT 'n' || n_nationkey AS s, 'r' || n_regionkey AS o FROM nation UNION SELECT 'r' || r_regionkey, 'n' || (r_regionkey * 3) FROM region), l AS (SELECT s, o, count(*) OVER (PARTITION BY s) AS d FROM e), n AS (SELECT s AS node FROM e UNION SELECT o FROM e), t AS (SELECT count(*) AS c FROM n), r0 AS (SELECT node, 1.0::DOUBLE / c AS r FROM n, t), "
    + ", ".join(_RANK_STEP.format(k=k + 1, j=k) for k in range(3))
    + " SELECT node, round(r, 9) AS rank FROM r3"
)
def pagerank_fixed_iters(spark, sf_dir):
    iri = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    e = _t(spark, sf_dir, "nation").select(iri("n", F.col("n_nationkey")).alias("s"), iri("r", F.col("n_regionkey")).alias("o"))
    e = e.union(_t(spark, sf_dir, "region").select(iri("r", F.col("r_regionkey")), iri("n", F.col("r_regionkey") * 3)))
    return analytics.pagerank(e, steps=3).select("node", F.round("rank", 9).alias("rank"))


@query("SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation")
def bridges(spark, sf_dir):
    e = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))
    return analytics.cut_points(e).where("kind = 'bridge'").select("a", "b")


@query(
    """WITH c AS (SELECT l_partkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) SELECT p_partkey, CASE WHEN last IS NULL THEN 'missing' WHEN last < DATE '1998-01-01' THEN 'stale' ELSE 'covered' END AS status FROM part LEFT JOIN c ON l_partkey = p_partkey"""
)
def coverage_missing(spark, sf_dir):
    cover = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate")
    return analytics.uncovered(_t(spark, sf_dir, "part").select("p_partkey"), cover, "p_partkey", "l_shipdate", F.lit("1998-01-01").cast("timestamp"))


_DAYS_SQL = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS claims, count(DISTINCT user_id) AS users FROM events GROUP BY 1)"


def _days(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy(_iso("ts").alias("day")).agg(F.count("*").alias("claims"), F.count_distinct("user_id").alias("users"))


@query(f"WITH {_DAYS_SQL} SELECT day, claims, users, (sum(claims) OVER (ORDER BY day))::BIGINT AS claims_so_far FROM d")
def annealing_cumulative(spark, sf_dir):
    return analytics.running(_days(spark, sf_dir), "day", "claims")


@query(f"WITH {_DAYS_SQL} SELECT day, claims, users, claims - coalesce(lag(claims) OVER (ORDER BY day), 0) AS claims_change, users - coalesce(lag(users) OVER (ORDER BY day), 0) AS users_change FROM d")
def snapshot_delta(spark, sf_dir):
    return analytics.deltas(_days(spark, sf_dir), "day", "claims", "users")


@query("SELECT conv_id, turn, length(trim(text)) > 0 AS said FROM conversations")
def text_guard(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", non_blank(F.col("text")).alias("said"))


@query(
    """SELECT '<urn:order:' || o_orderkey || '> <urn:status> "' || o_orderstatus || '" <urn:g:orders> .' AS value FROM orders UNION ALL SELECT '<urn:order:' || o_orderkey || '> <urn:by> <urn:customer:' || o_custkey || '> <urn:g:orders> .' FROM orders
UNION ALL SELECT '<urn:customer:' || c_custkey || '> <' || p || '> ' || o || ' <urn:g:customers> .' FROM (SELECT c_custkey, '"""
    + _TYPE
    + """' AS p, '<urn:Customer>' AS o FROM customer UNION ALL SELECT c_custkey, 'urn:segment', '"' || c_mktsegment || '"' FROM customer)"""
)
def nquads_lines(spark, sf_dir):
    return quads.nquads(_order_quads(spark, sf_dir))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'json' WHEN 2 THEN 'k' END AS error FROM events")
def record_shapes(spark, sf_dir):
    """Event properties as closed records: with a foreign field, cut off, with another type, or as they are."""
    k, text = F.col("event_id") % 4, F.col("props")
    spoilt = F.when(k == 0, F.regexp_replace(text, r"\}$", ',"x":1}')).when(k == 1, F.lit("{")).when(k == 2, F.lit('{"k":true}')).otherwise(text)
    return _t(spark, sf_dir, "events").select("event_id", records.shape_error("struct<k:int not null>")(spoilt).alias("error"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'prefix' WHEN 1 THEN 'confidence' WHEN 2 THEN 'content_id' WHEN 3 THEN 'mentions' END AS diagnostic FROM documents WHERE strpos(text, '.') > 0"""
)
def extraction_checks(spark, sf_dir):
    """Extractions that quote a document's first sentence, each spoilt by doc_id % 5; 4 is left sound."""
    i = F.col("doc_id")
    k, name = i % 5, i.cast("string")
    d = _t(spark, sf_dir, "documents").where(F.position(F.lit("."), F.col("text")) > 0).withColumn("a", _sentence_anchor()).withColumn("sha", F.sha2("text", 256))
    anchor = F.struct(
        F.col("sha").alias("canonical_text_sha256"), F.lit("1").alias("canonicaliser_version"), F.when(k == 2, "x").otherwise(name).alias("content_id"), F.col("a.end_line").alias("end_line"), F.col("a.end_offset").alias("end_offset"),
        F.when(k == 0, "x").otherwise(F.col("a.prefix")).alias("prefix"), F.col("a.selected_text").alias("selected_text"), F.col("sha").alias("source_json_sha256"), F.lit("u").alias("source_url"),
        F.col("a.start_line").alias("start_line"), F.col("a.start_offset").alias("start_offset"), F.col("a.suffix").alias("suffix"),
    )
    claim = F.struct(F.lit("a").alias("assertion"), F.when(k == 1, 2.0).otherwise(0.5).alias("confidence"), F.array(anchor).alias("evidence"), F.lit("r").alias("rationale"))
    whole = F.to_json(F.struct(F.array(claim).alias("candidate_claims"), F.array().cast("array<string>").alias("mentions"), F.array().cast("array<string>").alias("temporal_expressions")))
    output = F.when(k == 3, F.replace(whole, F.lit('"mentions"'), F.lit('"mention"'))).otherwise(whole)
    sources = d.select(name.alias("source_version"), F.col("text").alias("canonical_text"), F.lit("1").alias("canonicaliser_version"), F.col("sha").alias("source_json_sha256"), name.alias("content_id"), F.lit("u").alias("source_url"), F.col("sha").alias("canonical_text_sha256"))
    checked = extraction.check_extractions(d.select(name.alias("source_version"), output.alias("output")), sources)
    return checked.select(F.col("source_version").cast("long").alias("doc_id"), F.when(F.col("diagnostic") == "mention", "mentions").otherwise(F.col("diagnostic")).alias("diagnostic"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'calendar' WHEN o_custkey % 2 = 0 THEN 'recorded' ELSE 'none' END AS methodology,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_custkey % 2 = 0 THEN '2000-01-01' END AS lower_bound FROM orders"""
)
def temporal_hybrid(spark, sf_dir):
    """Dates by the calendar, other words by what was recorded for each customer's request."""
    o = _t(spark, sf_dir, "orders")
    payload = F.to_json(F.struct("o_custkey"))
    requests = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, _iso("o_orderdate")).otherwise("when it was made").alias("expression"), F.lit(None).cast("string").alias("reference"), payload.alias("payload"))
    answer = '{"constraint":{"lower_bound":"2000-01-01","lower_inclusive":true,"upper_bound":null,"upper_inclusive":true}}'
    recorded = o.where("o_custkey % 2 = 0").select(F.lit("temporal-resolution").alias("stage"), payload.alias("structured_input"), F.lit(answer).alias("structured_output"), F.lit(1).alias("sequence")).distinct()
    return resolution.resolve_times(requests, recorded).select("o_orderkey", "methodology", "constraint.lower_bound")


@query(
    """SELECT doc_id::VARCHAR AS claim_id, CASE WHEN quality = 0 THEN 'out_of_scope' WHEN doc_id % 3 = 0 THEN 'ontology_gap' WHEN doc_id % 2 = 0 AND toxic = 1 THEN 'conflict' ELSE 'accepted' END AS disposition,
  CASE WHEN quality = 1 AND doc_id % 3 <> 0 AND doc_id % 2 = 0 AND toxic = 1 THEN 'Conflicts with accepted Claim ''old' || doc_id || ''' on ''urn:d:' || doc_id || ''' and ''urn:toxic''.' ELSE 'c' END AS conflict FROM labels"""
)
def claim_decisions(spark, sf_dir):
    """Labels as decided claims: some use a predicate that the ontology lacks, some contradict an accepted claim."""
    i = F.col("doc_id")
    subject = F.concat(F.lit("urn:d:"), i.cast("string"))
    one = F.struct(F.col("toxic").cast("string").alias("object"), F.lit("literal").alias("object_kind"), F.when(i % 3 == 0, "urn:new").otherwise("urn:toxic").alias("predicate"), subject.alias("subject"))
    held = F.when(F.col("quality") == 1, F.array(one)).otherwise(F.slice(F.array(one), 1, 0))
    output = F.to_json(F.struct(F.lit("a").alias("acceptance"), F.lit("c").alias("conflict"), F.when(F.col("quality") == 1, "accepted").otherwise("out_of_scope").alias("disposition"), F.lit("m").alias("mapping"), F.lit("s").alias("scope"), held.alias("semantic_assertions"), F.lit("v").alias("validation")))
    labels, never = _t(spark, sf_dir, "labels"), F.lit(None).cast(temporal.DDL)
    accepted = labels.where("doc_id % 2 = 0").select(F.concat(F.lit("old"), i.cast("string")).alias("claim_id"), subject.alias("subject"), F.lit("urn:toxic").alias("predicate"), F.lit("0").alias("object"), F.lit("literal").alias("object_kind"), never.alias("time"))
    known = spark.createDataFrame([("urn:toxic", "urn:a", "urn:Property")], "s string, p string, o string")
    return decisions.decide(labels.select(i.cast("string").alias("claim_id"), never.alias("time"), output.alias("output")), accepted, known, []).select("claim_id", "disposition", "conflict")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'existing' END AS error FROM nation")
def entity_outcomes(spark, sf_dir):
    """Recorded outcomes that name the nation itself, or a name that is none of the candidates."""
    n = _t(spark, sf_dir, "nation")
    payload = F.to_json(F.struct("n_nationkey"))
    requests = n.select("n_nationkey", F.col("n_name").alias("mention"), F.array("n_name").alias("candidates"), payload.alias("payload"))
    answer = F.to_json(F.struct(F.lit("existing").alias("kind"), F.when(F.col("n_nationkey") % 3 == 1, "elsewhere").otherwise(F.col("n_name")).alias("entity_id")))
    recorded = n.where("n_nationkey % 3 <> 2").select(F.lit("entity-resolution").alias("stage"), payload.alias("structured_input"), answer.alias("structured_output"), F.lit(1).alias("sequence"))
    return resolution.resolve_entities(requests, recorded).select("n_nationkey", "error")


@query("SELECT 'urn:' || event_type AS term FROM events WHERE event_type <> 'view' GROUP BY 1")
def ontology_terms_absent(spark, sf_dir):
    """Event types that a vendored ontology's text does not hold."""
    from ..functions.turtle import triples

    text = spark.createDataFrame([("o", "<urn:a> <urn:view> <urn:b> .")], "source string, ttl string")
    terms = _t(spark, sf_dir, "events").select(F.lit("o").alias("source"), F.concat(F.lit("urn:"), "event_type").alias("term")).distinct()
    return ontology.absent_terms(terms, triples(text, "ttl", "source")).select("term")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN NULL WHEN turn = t0 THEN 'missing' END AS error FROM (SELECT DISTINCT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM conversations) WHERE turn % 3 = 2")
def reversal_errors(spark, sf_dir):
    t = _turns(spark, sf_dir)
    bad = history.reversal_error(t.where("kind = 'reversal'"), t)
    part = F.split("decision_id", ":")
    return bad.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "error")


def _bodies(spark, sf_dir) -> DataFrame:
    """Documents as JSON objects; by doc_id % 5 one has no id, a number for an id, a path that is none, or is a list."""
    k = F.col("doc_id") % 5
    content = F.when(k == 1, F.lit("null")).when(k == 2, "7").otherwise(F.to_json(F.array(F.col("lang"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("lang")))) - 2))
    path = F.when(k == 3, "source").otherwise(F.concat(F.lit("/"), "source"))
    body = F.concat(F.lit('{"content_id":'), content, F.lit(',"base_path":"'), path, F.lit('"}'))
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(k == 4, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("body"))


@query(
    """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'content_id' WHEN 2 THEN 'content_id' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'content_id' ELSE 'source_url' END WHEN 4 THEN 'source_json'
  ELSE CASE WHEN doc_id % 2 = 0 THEN 'content_id' WHEN doc_id % 3 = 0 THEN 'source_url' END END AS error FROM documents"""
)
def source_identity(spark, sf_dir):
    """Anchors against the identity that their retained documents declare: every second names another document, every third another address."""
    content = F.when(F.col("doc_id") % 2 == 0, "another").otherwise(F.col("lang"))
    url = F.concat(F.when(F.col("doc_id") % 3 == 0, "https://elsewhere.example/").otherwise("https://site.example/"), "source")
    anchor = F.struct(content.alias("content_id"), url.alias("source_url"))
    return _bodies(spark, sf_dir).select("doc_id", canonical.identity_error(anchor, F.col("body"), "https://site.example").alias("error"))


@query(
    """WITH d AS (SELECT doc_id, '{"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}' AS payload FROM documents)
SELECT doc_id, 'sha256:' || sha256('{"payload":{"input":' || payload || ',"stage":"claim-decision"},"schema_version":"1"}') AS request_id FROM d"""
)
def request_identity(spark, sf_dir):
    return requests.create(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "claim-decision", "lang", "source").select("doc_id", "request_id")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'missing' WHEN 2 THEN 'identity' END AS diagnostic, CASE WHEN doc_id % 4 = 3 THEN '{"toxic":' || toxic || '}' END AS output FROM labels"""
)
def request_replay(spark, sf_dir):
    """Results of labels' requests, spoilt by doc_id % 4: the request's bytes changed, no result, a result under another name, sound."""
    k = F.col("doc_id") % 4
    rows = requests.create(_t(spark, sf_dir, "labels").select("doc_id", "toxic"), "temporal-resolution", "doc_id")
    body = F.concat(F.lit('{"output":{"toxic":'), F.col("toxic").cast("string"), F.lit('},"request":"'), F.col("request_id"), F.lit('"}'))
    results = rows.where(k != 1).select(body.alias("result"), F.when(k == 2, "sha256:x").otherwise(requests.identity(body, canonical=True)).alias("result_id"))
    changed = rows.withColumn("request", F.when(k == 0, F.lit("{}")).otherwise(F.col("request")))
    return requests.replay(changed, results).select("doc_id", "diagnostic", "output")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'shape' END AS entity, CASE WHEN doc_id % 3 <> 1 THEN 'shape' END AS time FROM labels")
def completed_results(spark, sf_dir):
    k = F.col("doc_id") % 3
    record = F.when(k == 0, '{"history":[],"reasoning_invocation":{},"request":{}}').when(k == 1, '{"outcome":{},"reasoning_invocation":{},"request":{}}').otherwise('{"outcome":{},"request":{}}')
    return _t(spark, sf_dir, "labels").select("doc_id", requests.completed_error(record, "entity-resolution").alias("entity"), requests.completed_error(record, "temporal-resolution").alias("time"))


@query(
    """SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'target' WHEN 1 THEN 'head' WHEN 2 THEN 'reversed' END AS error FROM (SELECT DISTINCT conv_id FROM conversations)"""
)
def history_append(spark, sf_dir):
    """New decisions on each conversation's history: a merge into one of its sources, one that does not follow the newest, a reversal of nothing, a sound one."""
    turns = _turns(spark, sf_dir)
    last = turns.groupBy(F.split_part("decision_id", F.lit(":"), F.lit(1)).cast("long").alias("conv_id")).agg(F.max_by("decision_id", F.split_part("decision_id", F.lit(":"), F.lit(2)).cast("int")).alias("head"))
    k, a = F.col("conv_id") % 4, lambda *x: F.array(*[F.lit(y) for y in x])
    new = last.select(
        "conv_id", F.when(k == 1, "nowhere").otherwise(F.col("head")).alias("previous_id"), F.when(k == 2, "reversal").otherwise("merge").alias("kind"), a("a", "b").alias("sources"),
        F.when(k == 0, a("a")).otherwise(a("c")).alias("targets"), F.when(k == 2, F.lit("nothing")).alias("reversed_id"), F.lit("{}").alias("provenance"),
    )
    return history.append(turns, new).select("conv_id", "error")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ontology research record has no Ontology-gap Claim.' WHEN 1 THEN 'Ontology research record has an invalid Ontology-gap Claim.'
  ELSE CASE WHEN toxic = 0 THEN 'Ontology research record has an invalid Ontology-gap Claim.' WHEN doc_id % 4 = 2 THEN 'The Ontology-gap Claim that prompted research must be reconsidered.' END END AS diagnostic FROM labels"""
)
def research_gaps(spark, sf_dir):
    """Research records that name no claim, a thing that is no claim, or the label's claim; toxic ones are gaps, and some of them are reconsidered."""
    rows = _t(spark, sf_dir, "labels").withColumn("identity", sha_identity(F.col("doc_id").cast("string")))
    k = F.col("doc_id") % 4
    gap = F.when(k == 1, F.lit('"x"')).otherwise(F.concat(F.lit('{"identity":"'), "identity", F.lit('","kind":"claim-mapping","schema_version":"1"}')))
    research = rows.select("doc_id", F.col("doc_id").alias("proposal_id"), F.when(k == 0, "{}").otherwise(F.concat(F.lit('{"ontology_gap":'), gap, F.lit("}"))).alias("payload"))
    mappings = rows.select("identity", F.when(F.col("toxic") == 1, "ontology_gap").otherwise("accepted").alias("disposition"))
    again = rows.where(k == 3).select(F.col("doc_id").alias("proposal_id"), F.col("identity").alias("previous"))
    return ontology.gap_diagnostics(research, mappings, again).select("doc_id", "diagnostic")


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Expected ontology-decision causal artefact.' WHEN 1 THEN 'Causal artefact ' || doc_id || ' is invalid.' ELSE 'Causal artefact ' || doc_id || ' is not a critic decision.' END AS diagnostic
FROM labels WHERE doc_id % 3 < 2 OR toxic = 0"""
)
def causal_references(spark, sf_dir):
    """Critics' references: of another kind, not stored, or stored; the toxic ones alone are of the critic's stage."""
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    rows = _t(spark, sf_dir, "labels")
    references = rows.select(i.alias("identity"), F.lit("critic").alias("role"), F.when(k == 0, "claim").otherwise("ontology-decision").alias("kind"))
    stage = F.when(F.col("toxic") == 1, "critic").otherwise("proposer")
    store = rows.where(k == 2).select(i.alias("identity"), F.lit("ontology-decision").alias("kind"), F.to_json(F.struct(stage.alias("stage"))).alias("payload"))
    told = ontology.causal_diagnostics(references, store)
    return told.select(F.when(F.col("diagnostic").startswith("Causal"), F.regexp_extract("diagnostic", r"artefact (\d+) ", 1).cast("long")).alias("doc_id"), "diagnostic").where("doc_id is not null").unionByName(
        references.where("kind <> 'ontology-decision'").select(F.col("identity").cast("long").alias("doc_id"), F.lit("Expected ontology-decision causal artefact.").alias("diagnostic"))
    )


@query(
    """SELECT doc_id::VARCHAR AS claim_id, CASE WHEN quality = 0 THEN 'out_of_scope' ELSE 'conflict' END AS disposition, CASE WHEN quality = 0 THEN 's' ELSE 'c' END AS reason FROM labels WHERE quality = 0 OR toxic = 1"""
)
def claims_that_do_not_fit(spark, sf_dir):
    rows = _mappings(spark, sf_dir).join(_t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("claim_id"), "quality", "toxic"), "claim_id")
    return analytics.misfits(rows.withColumn("disposition", F.when(F.col("quality") == 0, "out_of_scope").when(F.col("toxic") == 1, "conflict").otherwise("accepted")))


@query("""SELECT 'urn:order:' || o_orderkey AS s, 'urn:by' AS p, 'urn:customer:' || o_custkey AS o FROM orders WHERE o_custkey = 1 UNION ALL SELECT 'urn:customer:1', p, o FROM customer, (VALUES (0)) AS z(z), LATERAL (VALUES ('%s', 'urn:Customer'), ('urn:segment', c_mktsegment)) AS t(p, o) WHERE c_custkey = 1""" % _TYPE)
def known_about(spark, sf_dir):
    return analytics.known_about(_order_quads(spark, sf_dir), "urn:customer:1").select("s", "p", "o")


@query(
    """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id FROM events), f AS (SELECT event_type, min(day) AS first FROM e GROUP BY 1)
SELECT day, count(*) AS rows, count(*) FILTER (event_type = 'error') AS gaps, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS gap_rate, count(DISTINCT event_type) AS clusters,
  count(DISTINCT event_type) FILTER (day = first) AS new_clusters, count(DISTINCT user_id) AS sources FROM e JOIN f USING (event_type) GROUP BY 1"""
)
def gap_measures(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(_iso("ts").alias("day"), "event_type", "user_id")
    return analytics.gap_measures(e, "day", "event_type", "user_id", F.col("event_type") == "error")


@query(
    f"""WITH d AS (SELECT doc_id, '{{"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}}' AS body, lang, source FROM documents), n AS (SELECT *, '{V("source-document/")}' || doc_id || '/' || sha256(body) AS node FROM d)
SELECT node || '/assertion/' || k AS s, CASE k WHEN 'lang' THEN to_json(lang)::VARCHAR ELSE to_json(source)::VARCHAR END AS o FROM n, (VALUES ('lang'), ('source')) AS ks(k)"""
)
def document_quads(spark, sf_dir):
    body = F.to_json(F.struct("lang", "source"))
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), body.alias("body"), F.sha2(body, 256).alias("sha"))
    return quads.source_quads(rows, "id", "body", "sha").where(F.col("p") == V("sourceValue")).select("s", "o")


@query(
    """WITH d AS (SELECT doc_id, text, greatest(length(text) // 2, 0) AS s FROM documents WHERE length(text) >= 80)
SELECT doc_id, s::INT AS start_offset, (s + 20)::INT AS end_offset, (length(text[1:s]) - length(replace(text[1:s], chr(10), '')))::INT AS start_line, (length(text[1:s + 19]) - length(replace(text[1:s + 19], chr(10), '')))::INT AS end_line,
  text[s + 1:s + 20] AS selected_text, text[s - 31:s] AS prefix, text[s + 21:s + 52] AS suffix, strpos(text, text[s + 1:s + 20]) <> s + 1 AS moved FROM d"""
)
def evidence_anchor_inside(spark, sf_dir):
    """Anchors in the middle of documents; moved where the passage stands earlier too."""
    start = F.floor(F.length("text") / 2).cast("int")
    d = _t(spark, sf_dir, "documents").where(F.length("text") >= 80).select("doc_id", "text", canonical.build_anchor(F.col("text"), start, start + 20).alias("a"))
    return d.select("doc_id", "a.*", (F.position(F.col("a.selected_text"), F.col("text")) != F.col("a.start_offset") + 1).alias("moved"))
