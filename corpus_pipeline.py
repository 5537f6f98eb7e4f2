"""A corpus from raw documents to token ids, in stages; each is written as Parquet and read again for the next.

Defined cases, for every stage: an empty table gives an empty table; a null text counts as empty, is not toxic, has
neither near-duplicates nor secrets and no words, and stays, with no ids; a null id is a document of its own, which no other
one replaces; rows that share an id are one document to near-duplicates (the group's rows all stay or all go) and rows of
their own elsewhere; texts are read whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm.bpe import bpe_stage
from claimloom.llm.common import discard, shared_dir, table
from claimloom.llm.mixing import mixing_stage
from claimloom.llm.neardup import neardup_stage
from claimloom.llm.secrets import secrets_stage
from claimloom.llm.toxicity import toxicity_stage

#: Name and function(spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity_stage),  # documents predicted toxic go
    ("near_dedup", neardup_stage),  # one document of each group stays
    ("secrets", secrets_stage),  # secrets are blotted out
    ("mixing", mixing_stage),  # sources come near their target weights; a document may be repeated
    ("bpe", bpe_stage),  # texts become token ids
]

#: Training, hashing and seeded choice are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages. What a stage leaves in the shared folder is deleted when the next one is written."""
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/claimloom/pipeline-{uuid.uuid4().hex}", []
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
