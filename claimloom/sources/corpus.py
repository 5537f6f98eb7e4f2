"""Evidence corpora: acquisition over a pluggable fetcher, the manifest, and verified reading.

A fetcher is a function(url) -> bytes that raises on failure; failures are data until the commit.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import passages_text

ENTRY = "sequence int, base_path string, content_id string, locale string, updated_at string, content_api_url string, source_json string, source_json_sha256 string, canonical_text string, canonical_text_sha256 string, canonicaliser_version string, source_version string"
MANIFEST = f"schema_version string, status string, acquisition struct<organisation:string,maximum:int,ordering:string>, source_documents array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"


class AcquisitionError(RuntimeError):
    """The corpus was not written; failures holds (stage, source_path, message)."""

    def __init__(self, failures: list[tuple]):
        super().__init__("; ".join(f"{s} {p}: {m}" for s, p, m in failures))
        self.failures = failures


def source_path(link: Column) -> Column:
    """The path of a link: null if it has a scheme or host or does not start with /; query and fragment dropped."""
    bare = F.regexp_replace(link, r"[?#].*$", "")
    return F.when(bare.rlike(r"^/(?!/)") & ~bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)


def enumerate_paths(fetch_page: Callable[[int, int], dict], most: int, page: int = 100) -> list[str]:
    """Paths of the first most search results, sorted. fetch_page(start, count) gives total and results with a link.

    Refuses a total that drifts, an early end, a missing or foreign link, and repeats."""
    size, found, total = min(most, page), [], None
    while total is None or len(found) < min(most, total):
        got = fetch_page(len(found), size)
        if total is not None and got["total"] != total:
            raise AcquisitionError([("enumerate", None, "the total changed between pages")])
        total = got["total"]
        links = [r.get("link") for r in got["results"]]
        if not links and len(found) < min(most, total):
            raise AcquisitionError([("enumerate", None, "the results ended early")])
        for link in links:
            bare = (link or "").partition("#")[0].partition("?")[0]
            if not bare.startswith("/") or bare.startswith("//"):
                raise AcquisitionError([("enumerate", link, "the result has no usable link")])
            found.append(bare)
        if not links:
            break
    found = found[:most]
    if len(set(found)) != len(found):
        raise AcquisitionError([("enumerate", None, "a document is listed twice")])
    return sorted(found)


def download(spark: SparkSession, paths: list[str], fetch: Callable[[str], bytes], api: str) -> DataFrame:
    """(sequence, base_path, ..., body, canonical, failure) of each path, fetched in parallel."""
    rows = spark.createDataFrame(list(enumerate(paths)), "sequence int, base_path string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sequence, path in zip(batch["sequence"], batch["base_path"]):
                body, text, ids, failure = None, None, (None, None, None), None
                try:
                    body = fetch(api + path)
                    document = json.loads(body)
                    ids = tuple(document[k] for k in ("content_id", "locale", "updated_at"))
                    if not all(isinstance(x, str) for x in ids):
                        failure = "an identity field is not text"
                    elif document.get("base_path") != path:
                        failure = "base_path is another document's"
                    text = passages_text(document)
                except Exception as error:  # the failure is the result
                    failure = f"{type(error).__name__}: {error}"
                out.append((sequence, path, *ids, body, text, failure))
            yield pd.DataFrame(out, columns=["sequence", "base_path", "content_id", "locale", "updated_at", "body", "canonical", "failure"])

    return rows.repartition(max(1, min(len(paths), 64)), "sequence").mapInPandas(run, "sequence int, base_path string, content_id string, locale string, updated_at string, body binary, canonical string, failure string")


def acquire(spark: SparkSession, directory: str, organisation: str, fetch: Callable[[str], bytes], fetch_page: Callable[[int, int], dict], api: str, most: int = 100) -> int:
    """Writes a corpus into an empty directory, the manifest last; all or nothing. Gives the number of documents."""
    if os.path.isdir(directory) and os.listdir(directory):
        raise FileExistsError(f"{directory} is not empty")
    os.makedirs(directory, exist_ok=True)
    try:
        rows = download(spark, enumerate_paths(fetch_page, most), fetch, api).orderBy("sequence").collect()  # at most `most` documents
        if bad := [("download", r.base_path, r.failure) for r in rows if r.failure]:
            raise AcquisitionError(bad)
    except AcquisitionError as error:
        report = {"failures": [{k: v for k, v in zip(("stage", "source_path", "message"), f) if v is not None} for f in error.failures], "schema_version": "1", "status": "incomplete"}
        _dump(os.path.join(directory, "acquisition-failure.json"), report)
        raise
    import hashlib

    entries = []
    for r in rows:
        body, text = bytes(r.body), r.canonical.encode()
        sha, name = hashlib.sha256(body).hexdigest(), f"{r.sequence:05d}"
        entries.append({
            "sequence": r.sequence, "base_path": r.base_path, "content_id": r.content_id, "locale": r.locale, "updated_at": r.updated_at, "content_api_url": api + r.base_path,
            "source_json": f"source-documents/{name}.json", "source_json_sha256": sha, "canonical_text": f"canonical-documents/{name}.txt",
            "canonical_text_sha256": hashlib.sha256(text).hexdigest(), "canonicaliser_version": "1", "source_version": f"content_id:{r.content_id}:sha256:{sha}",
        })
        for folder, ending, data in (("source-documents", "json", body), ("canonical-documents", "txt", text)):
            os.makedirs(os.path.join(directory, folder), exist_ok=True)
            with open(os.path.join(directory, folder, f"{name}.{ending}"), "xb") as out:
                out.write(data)
    _dump(os.path.join(directory, "manifest.json"), {"acquisition": {"maximum": most, "ordering": "base_path", "organisation": organisation}, "schema_version": "1", "source_documents": entries, "status": "complete"})
    return len(entries)


def _dump(path: str, value: dict) -> None:
    with open(path, "x", encoding="utf-8") as out:
        json.dump(value, out, indent=2, sort_keys=True, ensure_ascii=False)


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of a complete manifest."""
    whole = spark.read.schema(MANIFEST).json(f"{directory}/manifest.json", multiLine=True)
    first = whole.select("status", F.col("source_documents").isNotNull().alias("listed")).first()
    if first is None or first.status != "complete" or not first.listed:
        raise ValueError("the manifest is not of a complete acquisition")
    return whole.select(F.inline("source_documents"))


def manifest_error(entry: dict[str, Column], body: Column) -> Column:
    """First mismatch between a manifest row's columns and the bytes that it names, null if there is none."""
    text = F.decode(body, "UTF-8")
    rules = [
        (F.coalesce(entry["source_json"].rlike(r"(^/|(^|/)\.\.(/|$))"), F.lit(True)), "path"),
        (body.isNull(), "missing"),
        (F.sha2(body, 256) != entry["source_json_sha256"], "sha256"),
        (~F.get_json_object(text, "$.content_id").eqNullSafe(entry["content_id"]), "content_id"),
        (~F.concat(F.lit("content_id:"), entry["content_id"], F.lit(":sha256:"), entry["source_json_sha256"]).eqNullSafe(entry["source_version"]), "source_version"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def read_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Manifest rows with body (binary) and diagnostic."""
    rows = manifest(spark, directory)
    blobs = spark.read.format("binaryFile").load(f"{directory}/source-documents/*").select(F.concat(F.lit("source-documents/"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"), F.col("content").alias("body"))
    joined = rows.join(blobs, F.col("source_json") == F.col("name"), "left").drop("name")
    return joined.withColumn("diagnostic", manifest_error({c: F.col(c) for c in ("source_json", "source_json_sha256", "content_id", "source_version")}, F.col("body")))
