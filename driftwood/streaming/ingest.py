"""Incremental ingest with resume semantics, as an extension: what was written before is not written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from driftwood.operators.relational import resume


def ingest(spark: SparkSession, stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's new keys to the Parquet table out; restarts and repeated rows add nothing."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = resume(rows, spark.read.schema(batch.schema).parquet(out), key)
        rows.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
