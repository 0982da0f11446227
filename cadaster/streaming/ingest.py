"""Incremental ingest of arriving file rows: those with a known path and size are skipped.

What arrived within a time is known from the stream's own state, which the engine keeps by key and a restart finds again.
What is older is known from the manifest, a table laid out by a hash of the key: a batch reads the
buckets that its own new rows fall into, and of them the key columns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["project_id", "source_path", "file_size_bytes"]
#: Parts of a manifest. A part holds as many rows as the manifest has for each of them.
BUCKETS = 256


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    """File rows as they arrive in a folder of Parquet files, with arrived_at, when their file was written."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 50).parquet(path)
    return rows.withColumn("arrived_at", F.col("_metadata.file_modification_time"))


def unseen(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """The first row of each path and size; what is remembered is bounded by the watermark on arrived_at.

    Arrival, not the file's own date, is the time: a file that was changed long ago and is new here is not late.
    """
    return stream.withWatermark("arrived_at", within).dropDuplicatesWithinWatermark(KEY)


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def known(spark: SparkSession, manifest: str) -> DataFrame | None:
    try:
        return spark.read.parquet(manifest)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def ingest(stream: DataFrame, manifest: str, checkpoint: str, at_once: bool = True, within: str = "30 days", buckets: int = BUCKETS) -> StreamingQuery:
    """Appends to the manifest table the arriving rows that it does not hold yet; a batch that is run again adds nothing.

    checkpoint: where the stream keeps its place and the keys it has seen; a later call with the same one goes on from there.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        rows = batch.drop("arrived_at").withColumn("bucket", bucket(buckets))
        held = known(batch.sparkSession, manifest)
        if held is not None:
            some = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
            rows = rows.join(held.where(F.col("bucket").isin(some) & (F.col("epoch") < epoch)).select(*KEY), KEY, "left_anti")
        # a folder for each bucket and epoch: running an epoch again replaces its own rows only
        rows.withColumn("epoch", F.lit(epoch)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(manifest)

    writer = unseen(stream, within).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if at_once else writer).start()
