"""Canonical text of JSON source documents, and evidence anchored in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import arrow_function
from ..functions.markup import render

VERSION = "1"


def leaf_passages(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, order, pointer, value) of each string leaf of a JSON column.

    order sorts leaves as the document's keys and list places do, which the pointer texts do not;
    pointers escape ~ and / as JSON pointers do. What is not JSON has no leaves."""
    return documents.select(F.col(key), F.explode(_walk(F.col(body))).alias("leaf")).select(key, "leaf.*")


def leaves(root) -> list[dict]:
    """order, pointer and value of each string leaf of a JSON value, in order."""
    out, todo = [], [((), "", root)]
    while todo:
        order, pointer, value = todo.pop()
        if isinstance(value, str):
            out.append({"order": list(order), "pointer": pointer, "value": value})
        elif isinstance(value, dict):
            todo += [((*order, k), f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [((*order, f"{i:012d}"), f"{pointer}/{i}", v) for i, v in enumerate(value)]
    return sorted(out, key=lambda x: x["order"])


def passages_text(root) -> str:
    """Canonical text of a JSON value: a passage for each string, in the order of its keys."""
    text = "\n\n".join(f"{x['pointer']}:\n{render(x['value'])}" for x in leaves(root))
    return text + "\n" if text else ""


@arrow_function("array<struct<order:array<string>,pointer:string,value:string>>")
def _walk(text):
    import json

    try:
        return leaves(json.loads(text)) if text is not None else []
    except ValueError:
        return []


@arrow_function("string")
def _canonical_text(text):
    import json

    try:
        return passages_text(json.loads(text)) if text is not None else ""
    except ValueError:
        return ""


def canonical_documents(documents: DataFrame, key: str, body: str) -> DataFrame:
    """documents with canonical_text, canonical_sha256 and canonicaliser_version. Passages stand in the order of their keys; an object without strings has an empty text."""
    rows = documents.withColumn("canonical_text", _canonical_text(F.col(body)))  # within the row: keys may repeat or be null
    return rows.withColumn("canonical_sha256", F.sha2("canonical_text", 256)).withColumn("canonicaliser_version", F.lit(VERSION))


def source_identity(body: Column, site: str) -> Column:
    """Struct (content_id, source_url, error) that a retained JSON document declares; error names what is missing or malformed, in this order."""
    plain = F.json_object_keys(body).isNotNull()
    # a string stands in its JSON in quotes, which get_json_object takes off: to tell "1" from 1 the kind is read
    kinds = F.from_json(body, "struct<content_id:variant,base_path:variant>")
    text = lambda name: F.when(F.schema_of_variant(kinds[name]) == "STRING", F.get_json_object(body, f"$.{name}"))
    content, path = text("content_id"), text("base_path")
    known = F.coalesce(F.length(content) > 0, F.lit(False))
    rooted = F.coalesce(path.startswith("/"), F.lit(False))
    error = F.when(~plain, "source_json").when(~known, "content_id").when(~rooted, "source_url")
    return F.struct(F.when(plain & known, content).alias("content_id"), F.when(plain & rooted, F.concat(F.lit(site), path)).alias("source_url"), error.alias("error"))


def identity_error(anchor: Column, body: Column, site: str) -> Column:
    """First field by which an anchor (content_id, source_url, ...) is not bound to its retained JSON document, null if it is."""
    own = source_identity(body, site)
    return F.coalesce(
        F.when(own["error"].isin("source_json", "content_id"), own["error"]), F.when(~anchor["content_id"].eqNullSafe(own["content_id"]), "content_id"),
        own["error"], F.when(~anchor["source_url"].eqNullSafe(own["source_url"]), "source_url"),
    )


def lines_before(text: Column, offset: Column) -> Column:
    """Line feeds in the first offset characters."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def build_anchor(text: Column, start: Column, end: Column, margin: int = 32) -> Column:
    """Struct of offsets, lines and surroundings of text[start:end]."""
    return F.struct(
        start.cast("int").alias("start_offset"),
        end.cast("int").alias("end_offset"),
        lines_before(text, start).alias("start_line"),
        lines_before(text, end - 1).alias("end_line"),
        F.substring(text, start + 1, end - start).alias("selected_text"),
        F.substring(text, F.greatest(start - margin, F.lit(0)) + 1, F.least(start, F.lit(margin))).alias("prefix"),
        F.substring(text, end + 1, F.lit(margin)).alias("suffix"),
    )


def anchor_error(anchor: Column, text: Column, expected: dict[str, Column] | None = None) -> Column:
    """Name of the first field that is wrong, null if none is.

    expected gives columns for identity fields (such as canonicaliser_version, source_json_sha256,
    content_id, source_url, canonical_text_sha256), tested first, in its order."""
    a = lambda name: anchor[name]
    start, end, chosen = a("start_offset"), a("end_offset"), a("selected_text")
    before, after = F.length(a("prefix")), F.length(a("suffix"))
    n, first = F.length(chosen), F.position(chosen, text)
    once = (first > 0) & (F.position(chosen, text, first + 1) == 0)
    cut = lambda low, size: F.substring(text, low + 1, size)
    rules = [(~a(f).eqNullSafe(want), f) for f, want in (expected or {}).items()]
    rules += [
        (n == 0, "selected_text"),
        ((start < 0) | (end > F.length(text)) | (start >= end), "offset"),
        (once & (start != first - 1), "start_offset"),
        (once & (end != first - 1 + n), "end_offset"),
        (cut(start, end - start) != chosen, "selected_text"),
        ((start < before) | (cut(start - before, before) != a("prefix")), "prefix"),
        ((end + after > F.length(text)) | (cut(end, after) != a("suffix")), "suffix"),
        (a("start_line") != lines_before(text, start), "start_line"),
        (a("end_line") != lines_before(text, end - 1), "end_line"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])
