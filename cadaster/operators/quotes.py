"""Price quotes gathered from several sources: normalisation, applicability, fallback, summary, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import numbers

SOURCES = ["consortium_immobilier", "lesclesdumidi", "terrain_construction", "meilleursagents"]
LEVELS = ["block", "district", "commune", "department", "country"]
BLOCK = "type_bien: string, prix_m2_min: double, prix_m2_moyen: double, prix_m2_max: double"


def requests(subjects: DataFrame) -> DataFrame:
    """One row per subject and source with a status where the source cannot be asked; null means ask."""
    rows = subjects.withColumn("source", F.explode(F.lit(SOURCES)))
    land, place = F.col("source") == "terrain_construction", F.coalesce("city", F.lit("")) != ""
    code = F.coalesce("postcode", F.lit("")) != ""
    status = F.when(land & (F.col("property_type") != "maison"), "skipped").when((F.col("source") != "meilleursagents") & ~(place & code), "error")
    return rows.withColumn("status", status)


def price_block(blocks: Column, wanted: Column) -> Column:
    """The block of the wanted type, else the only one, else the first that has a price; null if none."""
    same = F.get(F.filter(blocks, lambda b: F.lower(F.trim(b["type_bien"])) == F.lower(F.trim(wanted))), 0)
    priced = F.get(F.filter(blocks, lambda b: F.coalesce(b["prix_m2_min"], b["prix_m2_moyen"], b["prix_m2_max"]).isNotNull()), 0)
    return F.coalesce(same, F.when(F.size(blocks) == 1, F.get(blocks, 0)), priced)


def normalise(raw: DataFrame) -> DataFrame:
    """source, subject_id, property_type, low, mid, high, error, status of each reply."""
    b = price_block(F.col("prix"), F.col("property_type"))
    rows = raw.withColumn("block", b).select(
        "source", "subject_id", F.coalesce("property_type", "block.type_bien").alias("property_type"),
        F.coalesce("tranche_basse", "block.prix_m2_min").alias("low"), F.coalesce("prix_m2_moyen", "block.prix_m2_moyen").alias("mid"), F.coalesce("tranche_haute", "block.prix_m2_max").alias("high"),
        "error", "status",
    )
    given = F.nullif(F.lower(F.trim("status")), F.lit(""))
    found = F.coalesce("low", "mid", "high").isNotNull()
    return rows.withColumn("status", F.coalesce(given, F.when(F.coalesce("error", F.lit("")) != "", "error").when(found, "ok").otherwise("empty")))


def summary(quotes: DataFrame, *keys: str) -> DataFrame:
    ok = F.col("status") == "ok"
    at = lambda c: F.when(ok, F.col(c))
    return quotes.groupBy(*keys).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "error", "empty", "skipped")),
        numbers.mean(at("low")).alias("low"), numbers.mean(at("mid")).alias("mid"), numbers.mean(at("high")).alias("high"), F.min(at("mid")).alias("min_mid"), F.max(at("mid")).alias("max_mid"),
    )


def with_average(quotes: DataFrame) -> DataFrame:
    """The quotes, and a row with the averages of each subject's."""
    rows = quotes.select("subject_id", "source", "low", "mid", "high", "status")
    total = summary(quotes, "subject_id").select("subject_id", F.lit("Moyenne globale").alias("source"), "low", "mid", "high", F.lit("synthese").alias("status"))
    return rows.unionByName(total)


def missing_types(quotes: DataFrame, expected: list[str]) -> DataFrame:
    """subject_id, missing: expected types that no ok quote of the subject has; all of them where none is ok."""
    found = quotes.groupBy("subject_id").agg(F.collect_set(F.when(F.col("status") == "ok", F.col("property_type"))).alias("found"))
    return found.select("subject_id", F.array_join(F.array_sort(F.array_except(F.lit(expected), "found")), ",").alias("missing"))


def with_fallback(places: DataFrame, prices: DataFrame) -> DataFrame:
    """A place's price by district, else city, else department, and which level gave it.

    places: place_id, district, city, department. prices: level, code, price.
    """
    out = places
    for level in ("district", "city", "department"):
        own = prices.where(F.col("level") == level).select(F.col("code").alias(level), F.col("price").alias(f"{level}_price"))
        out = out.join(own, level, "left")
    levels = F.when(F.col("district_price").isNotNull(), "district").when(F.col("city_price").isNotNull(), "city").when(F.col("department_price").isNotNull(), "department")
    return out.select("place_id", F.coalesce("district_price", "city_price", "department_price").alias("price"), levels.alias("fallback_level"))


def finest(places: DataFrame, prices: DataFrame) -> DataFrame:
    """Of each place's locations, finest to coarsest, the first that has a price.

    places: place_id, codes array<string> in the order of LEVELS. prices: level, code, price.
    """
    named = places.select("place_id", F.posexplode("codes").alias("rank", "code")).withColumn("level", F.get(F.lit(LEVELS), F.col("rank")))
    found = named.join(prices, ["level", "code"])
    return found.groupBy("place_id").agg(F.min_by(F.struct("level", "code", "price"), "rank").alias("x")).select("place_id", "x.*")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest payload of each key; snapshots are only ever appended."""
    return snapshots.groupBy("key").agg(F.max_by(F.struct("cached_at", "payload"), F.struct("cached_at", "payload")).alias("x")).select("key", "x.*")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("day").parquet(path)


def ordered_union(first: Column, second: Column) -> Column:
    """Distinct values of both lists in order of first appearance."""
    return F.array_distinct(F.concat(first, second))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
