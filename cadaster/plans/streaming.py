"""The query on incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.plans.corpus import FILES
from cadaster.sources.inventory import shared_folder
from cadaster.sources.views import files, files_before
from cadaster.streaming import ingest


def t_inc_arriving_files(spark, sf_dir):
    """The inventory of the run before, then today's, through a stream; unchanged files are taken once."""
    base = shared_folder(spark, "stream")
    columns = ["project_id", "source_path", "file_size_bytes", "modified_at"]
    for rows in (files_before(spark, sf_dir), files(spark, sf_dir)):
        rows.select(*columns).write.mode("append").parquet(f"{base}/in")
        stream = ingest.arriving(spark, f"{base}/in", files(spark, sf_dir).select(*columns).schema)
        query = ingest.ingest(stream, f"{base}/manifest", f"{base}/checkpoint")
        query.awaitTermination()
    return spark.read.parquet(f"{base}/manifest").groupBy("project_id").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"))


QUERIES = {"t_inc_arriving_files": t_inc_arriving_files}

SQL = {"t_inc_arriving_files": f"WITH {FILES}, u AS (SELECT project_id, source_path, file_size_bytes FROM fb UNION SELECT project_id, source_path, file_size_bytes FROM fi) SELECT project_id, count(*) AS files, sum(file_size_bytes)::BIGINT AS bytes FROM u GROUP BY 1"}
