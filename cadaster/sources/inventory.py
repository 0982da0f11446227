"""Readers of file inventories, rule files, whole texts, chunk files, manifests and transaction pages."""

from __future__ import annotations

from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaster.functions import text

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; on a local master, where it is unset, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = mkdtemp(prefix="cadaster-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/cadaster-{name}-{uuid4().hex}"


SUFFIXES = ["pdf", "docx", "xlsx", "xls", "pptx", "txt", "md", "html", "csv"]


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root, without reading their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", f"^.*?{root.rstrip('/')}/", "")
    return supported(found.select(path.alias("source_path"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("file_type"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at")))


def supported(files: DataFrame) -> DataFrame:
    """Files of supported types outside archive folders."""
    return files.where(F.col("file_type").isin(SUFFIXES) & ~text.is_archived(F.col("source_path")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """source_path, file_type, text of text and Markdown files."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return rows.withColumn("file_type", F.lower(F.regexp_extract("source_path", r"\.([^./]+)$", 1)))


RULE = "fields array<struct<field_id: string, label: string, type: string, excel_sheet: string, source_dirs: array<string>, hint_keywords: array<string>>>"


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of all files, tagged with their source; fails on an id that two files give."""
    rows = spark.read.schema(RULE).option("multiLine", True).json(path).select(F.input_file_name().alias("source_file"), F.explode("fields").alias("f")).select("source_file", "f.*")
    rows = rows.where(F.coalesce("field_id", F.lit("")) != "")
    twice = [r.field_id for r in rows.groupBy("field_id").agg(F.count_distinct("source_file").alias("n")).where("n > 1").orderBy("field_id").limit(21).collect()]
    if twice:
        raise ValueError(f"rules given by more than one file: {', '.join(twice[:20])}{' and others' if len(twice) > 20 else ''}")
    return rows


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("project_id").json(path)


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


MANIFEST = "project_id string, files array<struct<source_path: string, file_size_bytes: string, document_id: string, token_estimate: long>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of manifests, keyed by `path::size`; those without a path or a whole-number size are left out."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("project_id", F.explode("files").alias("f")).select("project_id", "f.*")
    rows = rows.where((F.coalesce("source_path", F.lit("")) != "") & F.rlike("file_size_bytes", F.lit(r"^\d+$")))
    return rows.withColumn("cache_key", F.concat("source_path", F.lit("::"), "file_size_bytes"))


FEATURE = "struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"


def transaction_features(pages: DataFrame) -> DataFrame:
    """One row per feature of pages (url, body) in any of three shapes: features, results, or a bare list."""
    shape = F.from_json("body", f"struct<features: array<{FEATURE}>, results: array<{FEATURE}>>")
    bare = F.when(F.startswith(F.ltrim("body"), F.lit("[")), F.from_json("body", f"array<{FEATURE}>"))
    return pages.select("url", F.explode(F.coalesce(bare, shape["features"], shape["results"])).alias("feature"))


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """A result table, as Parquet or JSON lines, in a folder for each value of `by`, written by one task each: a file a folder, not one for every task; an older result is replaced."""
    if by:
        df = df.repartition(*by)
    df.write.mode("overwrite").format(kind).partitionBy(*(by or [])).save(path)
