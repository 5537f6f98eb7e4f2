"""Once-only ingestion of source versions as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def versioned(documents: DataFrame, content_id: str, body: str) -> DataFrame:
    sha = F.sha2(F.col(body), 256)
    return documents.withColumn("source_version", F.concat(F.lit("content_id:"), F.col(content_id), F.lit(":sha256:"), sha))


def ingest(documents: DataFrame, content_id: str, body: str, path: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Writes each source version of a streaming table once, after stage; the state of versions seen lives in the checkpoint."""
    once = versioned(documents, content_id, body).dropDuplicates(["source_version"])

    def append(batch: DataFrame, number: int) -> None:
        stage(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch run again writes the same place

    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
