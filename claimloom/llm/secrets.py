r"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans (``assign``, ``access``, ``hex``) are found by pattern: leftmost, not overlapping
within a kind, matches that are too short dropped. Their places come from cutting the text at
the pattern: the lengths of the cuts and of the matches add up to the starts.

Weak candidates are parts that alone prove nothing: ``user`` (a named identifier), ``opaque``
(a long token of mixed characters) and ``endpoint`` (a URL or host with port). Each part has
a role - identifier, secret or endpoint. A weak part is reported only if a base span or a
weak part of another role stands within the same scope: at most ``reach`` code points between
them. Two weak parts must not overlap (a long path in a URL is no second part), and between them
``opaque`` counts only where it is mixed (two at least of lower case, upper case and digits): a
ruler of one letter is no key.

Texts are scanned once: base spans and weak parts are written, and the joins read those of texts
that have weak parts and two roles, each distinct text once. Weak parts that touch a base span are told by running
maxima in the order of starts. The interval join deals parts into bins of ``reach`` code
points (an interval stands in each bin it touches, a weak part's also one to each side) and
compares within a bin, so that its work follows the text's length and not the square of a
document's parts.

Defined cases: a null text counts as empty and has no spans (n_* 0, the digest of "");
texts of any length are scanned whole; repeated rows each get their spans; an empty table
gives an empty table; other columns play no part, and their names may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stash, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9][A-Za-z0-9._~:/?#@!$&*+,;=%-]*"
USER = r"""(?i:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"

#: Kind, pattern, what group's length must reach what, role. The order is that of spans with one start.
KINDS = (
    ("assign", ASSIGN, 1, 6, "secret"),
    ("access", ACCESS, 0, 20, "identifier"),
    ("hex", HEX, 0, 24, "secret"),
    ("user", USER, 0, 1, "identifier"),
    ("opaque", OPAQUE, 0, 32, "secret"),
    ("endpoint", ENDPOINT, 0, 10, "endpoint"),
)
BASE = 3
OPAQUE_RANK = [k[0] for k in KINDS].index("opaque")


def places(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """array<struct<start, rank, end>> of the pattern's matches whose group has so many characters."""
    cuts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = F.zip_with(F.slice(cuts, 1, F.greatest(F.size(found), F.lit(0))), F.zip_with(found, kept, lambda m, k: F.struct(F.length(m).alias("m"), F.length(k).alias("k"))), lambda c, m: F.struct(F.length(c).alias("c"), m["m"].alias("m"), m["k"].alias("k")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["c"]
        end = start + x["m"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["k"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _role(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), rank + 1)


def _fit(text: Column, part: Column) -> Column:
    """Whether a weak part may complete another weak part."""
    own = F.substring(text, part["start"] + 1, part["end"] - part["start"])
    sorts = sum((own.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    return (part["rank"] != OPAQUE_RANK) | (sorts >= 2)


def linked_parts(texts: DataFrame, reach: int) -> DataFrame:
    """(k, linked) of texts (k, base, weak): the weak parts that a part of another role completes within reach."""
    firm = F.transform("base", lambda b: F.struct(b.alias("s"), F.lit(True).alias("fit"), F.lit(True).alias("is_base")))
    soft = F.transform("weak", lambda w: F.struct(w["s"].alias("s"), w["fit"].alias("fit"), F.lit(False).alias("is_base")))
    pieces = texts.select("k", F.explode(F.concat(firm, soft)).alias("p")).select("k", "p.s.*", "p.fit", "p.is_base")
    # a part that touches a base span is that span, not a second one
    order = Window.partitionBy("k").orderBy("start")
    before = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rangeBetween(1, Window.unboundedFollowing))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    apart = stash(pieces.withColumn("touched", touched).where("is_base or not touched").withColumn("role", _role(F.col("rank"))), "parts", few=True)

    def bins(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / reach).cast("int"), F.floor(high / reach).cast("int")))

    strong = apart.where("is_base or fit").select("k", F.col("start").alias("b0"), F.col("end").alias("b1"), F.col("role").alias("b_role"), F.col("is_base").alias("b_base"), bins(F.col("start"), F.col("end")).alias("bin"))
    parts = apart.where("not is_base").withColumn("bin", bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach))
    near = (
        (parts.k == strong.k) & (parts.bin == strong.bin) & (F.col("role") != F.col("b_role"))
        & (F.col("b0") - F.col("end") <= reach) & (F.col("start") - F.col("b1") <= reach)
        & (F.col("b_base") | (F.col("fit") & ((F.col("b0") >= F.col("end")) | (F.col("start") >= F.col("b1")))))
    )
    return parts.join(strong, near, "left_semi").groupBy("k").agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked"))


def find_secrets(docs: DataFrame, text: str = "text", reach: int = 200, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with base_spans and spans, arrays of (start, rank, end) sorted; rank is the place in KINDS."""
    keep = docs.columns if keep is None else keep
    n_base, n_spans, c_weak, c_key = fresh(keep, "base_spans", "spans", "weak_", "key_")
    body = F.coalesce(F.col(text), F.lit(""))
    each = [places(body, *kind[1:4], rank) for rank, kind in enumerate(KINDS)]
    rows = docs.withColumn(n_base, F.array_sort(F.concat(*each[:BASE])))
    rows = rows.withColumn(c_weak, F.transform(F.concat(*each[BASE:]), lambda w: F.struct(w.alias("s"), _fit(body, w).alias("fit"))))
    # only where parts of two roles stand can a weak part have its complement
    roles = F.size(F.array_distinct(F.concat(F.transform(n_base, lambda p: _role(p["rank"])), F.transform(c_weak, lambda p: _role(p["s"]["rank"])))))
    rows = rows.withColumn(c_key, F.when((F.size(c_weak) > 0) & (roles > 1), F.sha2(body, 256)))
    rows = stash(rows.select(*keep, n_base, F.when(F.col(c_key).isNotNull(), F.col(c_weak)).alias(c_weak), c_key), "spans")

    asked = rows.where(F.col(c_key).isNotNull())
    texts = asked.select(F.col(c_key).alias("k"), F.col(n_base).alias("base"), F.col(c_weak).alias("weak")).dropDuplicates(["k"])
    linked = linked_parts(texts, reach).toDF(f"{c_key}k", f"{c_key}linked")
    found = asked.join(linked, F.col(c_key) == F.col(f"{c_key}k"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = found.select(*keep, n_base, F.array_sort(F.concat(F.col(n_base), F.coalesce(F.col(f"{c_key}linked"), none))).alias(n_spans))
    return rows.where(F.col(c_key).isNull()).select(*keep, n_base, F.col(n_base).alias(n_spans)).union(found)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each span, or run of overlapping spans, replaced by mark."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[count(rank).alias(f"n_{KINDS[rank][0]}") for rank in range(BASE)],
        F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base_spans")).cast("long").alias("n_linked"),
    )


def secrets_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets blotted out and n_chars counted anew where that changed the text."""
    found = find_secrets(docs)
    spans = found.columns[-1]
    hit = F.size(spans) > 0
    clean = found.withColumn("text", redact(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def _sql() -> str:
    """The same in SQL: places by cutting the text, links by comparing every part with every other of its document."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    kinds = "\nUNION ALL\n".join(
        f"""SELECT doc_id, t, {rank} AS rank, '{kind}' AS kind, '{role}' AS role, string_split_regex(t, {quoted(pattern)}) AS g, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_extract_all(t, {quoted(pattern)}, {group}) AS v, {least} AS least FROM d"""
        for rank, (kind, pattern, group, least, role) in enumerate(KINDS)
    )
    sorts = " + ".join(f"regexp_matches(own, '[{x}]')::INTEGER" for x in ("a-z", "A-Z", "0-9"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS ({kinds}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
p AS (SELECT doc_id, rank, kind, role, m[i] AS own, len(m[i]) AS size, len(v[i]) >= least AS ok,
  list_sum(list_transform(g[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)::BIGINT AS s FROM i),
q AS (SELECT doc_id, rank, kind, role, s, s + size AS e, rank < {BASE} AS base, rank <> {OPAQUE_RANK} OR {sorts} >= 2 AS fit FROM p WHERE ok),
c AS (SELECT * FROM q WHERE base OR NOT EXISTS (SELECT 1 FROM q b WHERE b.base AND b.doc_id = q.doc_id AND b.s < q.e AND q.s < b.e)),
a AS (SELECT * FROM c WHERE base OR EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.role <> c.role AND o.s - c.e <= 200 AND c.s - o.e <= 200
  AND (o.base OR c.fit AND o.fit AND (o.s >= c.e OR c.s >= o.e)))),
o AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank >= {BASE}) AS n3,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM a GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n3, 0) AS n_linked
FROM d LEFT JOIN o USING (doc_id)"""


SQL = _sql()
