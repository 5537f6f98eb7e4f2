import re

from pyspark.sql import functions as F

from claimloom.llm.licenses import BASE, op7_licenses, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "...", "CC BY cc by-nc CC BY", "Licensed under CC BY-NC 4.0.", "all rights reserved All Rights Reserved", "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "apache was here; a license too. version 2, then 0",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "the mit license of cc", "ÉCOLE cc by", "rights reserved all",
    "word " * 5000 + "all rights reserved " + "word " * 5000,
]


def brute(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = sorted((i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels = sorted({label for _, label in found})
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(labels)


def test_base_places_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, SCORE string")
    out = scan_licenses(docs)
    assert "_score" in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(TEXTS):
        assert tuple(rows[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute(text), text
        assert set(rows[i].base_labels.split(",")) <= set(rows[i].labels.split(",")) | {""} and 0 <= rows[i]["_score"] <= 1
    assert [rows[i].labels for i in (4, 6, 7, 8, 9, 10, 11)] == ["cc-by,cc-by-nc", "mit", "apache-2.0", "gpl", "", "mit", ""]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_whole_table_matches_brute_force(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op7_licenses(spark, path).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    assert {x for r in rows for x in r.labels.split(",")} >= {"mit", "apache-2.0", "gpl", "cc-by-nc"}
    assert all((r.score > 0) == bool(r.labels) for r in rows)
