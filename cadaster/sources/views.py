"""Input tables of the library, derived from the given tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold properties."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_extendedprice AS total_price",
        "l_quantity AS living_area",
        "cast(1 + l_partkey % 5 AS int) AS rooms",
        "cast(l_shipdate AS date) AS sale_date",
        "CASE WHEN l_partkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type",
        "concat('RUE ', l_suppkey % 10) AS street",
        "cast(l_partkey % 7 AS int) AS number",
        "43.0D + (l_partkey % 100000) / 5000.0D AS lat",
        "2.25 + (l_suppkey % 100) / 1000.0D AS lon",
        "l_quantity * 3 AS land_area",
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties to value: every customer. As places follow from the keys, a subject has as many sales near it at every size."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS subject_id",
        "43.0D + (c_custkey % 100000) / 5000.0D AS lat",
        "2.25D + (c_custkey % 100) / 1000.0D AS lon",
        "CASE WHEN c_custkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type",
        "cast(20 + c_custkey % 80 AS double) AS living_area_sqm",
        "cast(1 + c_custkey % 5 AS int) AS rooms",
        "cast(60 + c_custkey % 240 AS double) AS land_area_sqm",
        "concat('RUE ', c_custkey % 10) AS street_name",
        "500 AS search_radius_m",
        "1996 AS min_year",
        "date'1998-09-02' AS valuation_date",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory of every project; a project has some dozen files, however many documents there are."""
    folder = """CASE doc_id % 6 WHEN 0 THEN '3. RH/Dupont Marie' WHEN 1 THEN '4. Bilans/SCI Lumière' WHEN 2 THEN 'Société Emprunteuse'
        WHEN 3 THEN 'X - Old' WHEN 4 THEN '5. Opération' ELSE 'Annexes' END"""
    return table(spark, sf_dir, "documents").selectExpr(
        "concat(source, '-', cast(floor(doc_id / 500) AS int)) AS project_id",
        f"concat('2. Audit/1. Opérateur/', {folder}, '/Doc ', doc_id, ' ', 2018 + doc_id % 6, CASE doc_id % 11 WHEN 0 THEN '.zip' WHEN 1 THEN '.xlsx' ELSE '.pdf' END) AS source_path",
        "cast(n_chars AS long) AS file_size_bytes",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 300 AS int)) AS modified_at",
        "doc_id",
    ).withColumns({"filename": F.element_at(F.split("source_path", "/"), -1), "file_type": F.element_at(F.split("source_path", r"\."), -1)})


def files_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of the run before: every seventh file is missing, every fifth had another size, some are gone now."""
    now = files(spark, sf_dir)
    kept = now.where("doc_id % 7 <> 0").withColumn("file_size_bytes", F.expr("CASE WHEN doc_id % 5 = 0 THEN file_size_bytes + 10 ELSE file_size_bytes END"))
    gone = now.where("doc_id % 13 = 0").withColumn("source_path", F.concat(F.lit("2. Audit/Ancien/"), "filename"))
    return kept.unionByName(gone)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the questions put to each document of each project."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('p', cast(floor(user_id / 3) AS int)) AS project_id",
        "event_id AS document_id",
        "event_id AS doc_ordinal",
        "event_type AS field_id",
        "concat('e', user_id % 3) AS entity_key",
        "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '[]' ELSE cast(cast(value * 100 AS long) AS string) END AS value",
    )
