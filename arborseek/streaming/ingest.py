"""Keeping a ledger-driven index fed from a stream: each micro-batch is one run of the change operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from arborseek.operators.changes import Ledger, run_once


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint, so that the batches of a new one aren't taken for those of the old."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-name")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    if not fs.exists(path) or not fs.exists(held):
        out = fs.create(path, True)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ingest(rows: DataFrame, ledger: Ledger, process: Callable[[DataFrame, str], None], checkpoint: str, key: str = "doc_id", version: str = "mtime", stamp: str | None = None) -> StreamingQuery:
    """Feed ``process(new_rows, run_id)`` with the rows of a stream whose (key, version) pair is new; available data, then stop.

    A batch that failed is replayed by the engine under the same id. If it had been recorded, the replay does nothing;
    if not, it is given to ``process`` again, with the rows that the ledger still lacks, and recorded when ``process``
    has returned. ``process`` must therefore replace by ``run_id``, not append. ``stamp`` names a column with the
    moment a row was written, where there is one: rows before the ledger's bound are then left out unread.
    """
    name = stream_name(rows.sparkSession, checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        moment = [F.col(stamp).alias("__stamp")] if stamp else []
        keyed = df.select(F.col(key).alias("key"), F.col(version).cast("timestamp").alias("version"), *moment, F.struct("*").alias("row"))
        run_once(keyed, ledger, f"{name}-{batch_id:020d}", lambda new, run: process(new.select("row.*"), run), datetime.now(UTC).replace(tzinfo=None), "__stamp" if stamp else None)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Chunk rows as parquet files of a folder arrive, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
