"""Documents that arrive as message files are upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.messages import documents, outcomes
from ..store import DocumentStore


def ingest(spark: SparkSession, folder: str, store: DocumentStore, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Starts a query that upserts the documents of every new file in ``folder`` (a message a line) and ends when
    none is left. Of one path the last wins: by batch, then by time of the file, its name and the place in it. What becomes of each
    message is stored with its batch. A batch that is run again after a failure is put once: the store knows the last number of
    the stream, which is named by its ``checkpoint``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    placed = lines.select("value", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("file"))

    def put(batch: DataFrame, number: int) -> None:
        line = F.struct("file", F.monotonically_increasing_id().alias("line"))
        store.upsert(documents(batch, number=line), outcomes=outcomes(batch, number=line), batch=(checkpoint, number))

    return placed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
