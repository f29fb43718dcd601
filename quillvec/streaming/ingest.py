"""Continuous ingest: a stream of operations becomes batches of a collection."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillvec.model import EmptyBatch
from quillvec.sources.store import Collection

OPERATIONS = "ord long, op string, id string, vector array<float>, metadata string"


def operations_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Operations in Parquet files that appear in a folder."""
    return spark.readStream.schema(OPERATIONS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch as one collection batch.

    Of several operations on an id in a micro-batch the last by `ord` counts, as a
    batch holds an id once.  The micro-batch number is part of the commit, so that a
    batch that is replayed after a failure is not written twice.
    """
    name = hashlib.sha256(checkpoint.encode()).hexdigest()

    def write(batch: DataFrame, number: int) -> None:
        newest = Window.partitionBy("id").orderBy(F.desc("ord"))
        last = batch.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
        try:
            collection.write(last, stream=(name, number))
        except EmptyBatch:
            pass

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
