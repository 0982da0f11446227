"""Queries on property comparables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import geo, numbers
from cadaster.operators import comparables as c
from cadaster.sources.views import subjects, table, transactions


def _each(spark: SparkSession, sf_dir: str, of, rows=c.compare) -> DataFrame:
    """of(rows(subjects, sales)), a table by subject_id; subjects that differ in their id alone have the same result."""
    return c.for_alike(subjects(spark, sf_dir), lambda s: of(rows(s, transactions(spark, sf_dir))))


def _flagged(s: DataFrame, sales: DataFrame) -> DataFrame:
    return c.mark_duplicates(c.candidates(s, sales).drop("valuation_date", "s_street", "s_rooms", "s_land", "s_area", "street_key"))


def p5_date_window(spark, sf_dir):
    s = subjects(spark, sf_dir).withColumn("min_year", F.when(F.col("subject_id") % 4 == 0, F.col("min_year")))
    t = transactions(spark, sf_dir)
    start = c.window_start(F.col("valuation_date"), F.col("min_year"))
    return c.box_join(s, t).where(F.col("sale_date").between(start, F.col("valuation_date"))).groupBy("subject_id").agg(F.count("*").alias("n"), F.min("sale_date").cast("string").alias("first"), F.max("sale_date").cast("string").alias("last"))


def p6_p7_property_type_and_rooms(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE l_partkey % 5 WHEN 0 THEN 'Un APPARTEMENT' WHEN 1 THEN 'Maison de ville' WHEN 2 THEN 'Local' END AS label",
        "cast(l_suppkey % 3 AS int) AS flats", "cast(l_linenumber % 2 AS int) AS houses", "l_quantity % 2 AS flat_area", "l_quantity % 3 AS house_area",
        "CASE WHEN l_partkey % 4 = 0 THEN cast(l_linenumber - 2 AS string) WHEN l_partkey % 4 = 1 THEN '3,0' END AS main_rooms",
        "array(cast(l_partkey % 3 = 0 AS int), cast(l_suppkey % 5 = 0 AS int), 0, cast(l_orderkey % 7 = 0 AS int), 0) AS counters",
    )
    kind = c.property_type(F.col("label"), F.col("flats"), F.col("houses"), F.col("flat_area"), F.col("house_area"))
    rows = raw.withColumn("kind", kind).withColumn("rooms", c.room_count(F.array("main_rooms"), F.col("kind"), F.col("counters")))
    return rows.groupBy("kind", "rooms").agg(F.count("*").alias("n"))


def p8_projection(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(
        rows, F.count("*").alias("n"), F.round(F.sum("price_per_sqm_eur"), 2).alias("price_m2"), F.round(F.sum("distance_m"), 1).alias("metres"), F.round(F.sum("land_area_sqm"), 2).alias("land")), c.candidates)


def p9_address_and_street(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_orderkey % 9 = 0 THEN concat(' Label ', o_custkey) END AS label",
        "array(cast(o_custkey % 20 AS string), CASE WHEN o_orderkey % 3 > 0 THEN 'RUE ' END, o_orderstatus, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN ' ' END) AS parts",
        "array(CASE WHEN o_orderkey % 7 = 0 THEN 'Quai Haut' END, CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE o_orderpriority END, o_orderstatus) AS streets",
    )
    return raw.select("id", c.full_address(F.col("label"), F.col("parts")).alias("address"), c.first_text(F.col("streets")).alias("street"))


def p10_exclusion_reason(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(c.exclusion_reason(rows), F.count("*").alias("n"), by=("reason",)), _flagged)


def j2_radius_join(spark, sf_dir):
    return c.nearby(subjects(spark, sf_dir), transactions(spark, sf_dir)).withColumn("metres", F.round("metres", 3))


def f16_f17_f18_geo(spark, sf_dir):
    rows = subjects(spark, sf_dir)
    ring = F.array(*(F.array(F.col("lon") + dx, F.col("lat") + dy) for dx, dy in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.03), (0.0, 0.01))))
    centre = geo.ring_centre(ring)
    return rows.select(
        "subject_id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 3).alias("metres"),
        F.round(geo.lat_delta(F.col("search_radius_m")), 8).alias("dlat"), F.round(geo.lon_delta(F.col("search_radius_m"), F.col("lat")), 8).alias("dlon"),
        F.round(centre["lon"], 8).alias("centre_lon"), F.round(centre["lat"], 8).alias("centre_lat"))


def f19_gap_and_decay(spark, sf_dir):
    gap = geo.relative_gap(F.col("l_quantity") - 10, F.col("l_linenumber") * 5.0)
    return table(spark, sf_dir, "lineitem").select(F.round(gap, 6).alias("gap"), F.round(geo.decay(gap, F.lit(0.14)), 6).alias("decay")).groupBy("gap", "decay").agg(F.count("*").alias("n"))


def w1_time_gap_dedup(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(rows, F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("kept"), by=("address",)), _flagged)


def a3_mad_outliers(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(
        rows.where("z IS NOT NULL"), F.count_if(F.col("reason") == "price_outlier_low").alias("low"), F.count_if(F.col("reason") == "price_outlier_high").alias("high"), F.round(F.sum("z"), 3).alias("z")))


def w2_ranking(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(rows, F.max("place").alias("places"), F.max(F.when(F.col("reason").isNull(), F.col("place"))).alias("last_retained"), F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best_score")))


def w3_top_ten(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: rows.where(F.col("place") <= c.RETAINED).select("subject_id", "place", "score", "address", "price_per_sqm_eur", "distance_m"))


def c1_similarity(spark, sf_dir):
    return _each(spark, sf_dir, lambda rows: c.per_subject(
        rows.withColumn("score", c.similarity()), F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.max("score").alias("best"), F.min("score").alias("least")), c.candidates)


def c2_price_premium(spark, sf_dir):
    ratio = F.col("o_totalprice") / 150000
    rows = table(spark, sf_dir, "orders").select(c.premium_bonus(ratio).alias("bonus"), c.low_price_penalty(ratio).alias("penalty"))
    return rows.groupBy("bonus", "penalty").agg(F.count("*").alias("n"))


def a1_statistics(spark, sf_dir):
    return _each(spark, sf_dir, c.statistics)


def a2_thirds(spark, sf_dir):
    return _each(spark, sf_dir, c.thirds)


def a4_exact_median(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.percentile("o_totalprice", 0.5).alias("median"))


def o1_latest_first(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, F.to_date("o_orderdate")).alias("day"))
    placed = days.withColumn("place", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc_nulls_last("day"), "o_orderkey")))
    return placed.select("o_custkey", "o_orderkey", "place")


def p17_display(spark, sf_dir):
    french = lambda name: numbers.french(F.col(name))
    return c.rows_for_alike(subjects(spark, sf_dir), transactions(spark, sf_dir), lambda *tables: c.compare(*tables).select(
        *("home", "property_type", "subject_id", "place"), F.when(F.col("reason").isNull(), "Oui").otherwise("Non").alias("retenu"), french("score").alias("score"), french("living_area_sqm").alias("surface"),
        F.date_format("sale_date", "dd/MM/yyyy").alias("date_vente"), french("total_price_eur").alias("prix"), french("price_per_sqm_eur").alias("prix_m2")))


def s2_summary_row(spark, sf_dir):
    def with_mean(rows):
        # one pass over the pairs: the mean is an entry after the sales of a subject
        line = lambda place, label, price: F.struct(place.cast("int").alias("place"), F.lit(label).alias("label"), price.alias("price_m2"))
        ten = c.per_subject(rows.where(F.col("place") <= c.RETAINED), F.collect_list(line(F.col("place"), "Vente", F.col("price_per_sqm_eur"))).alias("sales"), numbers.mean(F.col("price_per_sqm_eur")).alias("mean"))
        return ten.select("subject_id", F.inline(F.concat("sales", F.array(line(F.lit(None), "Moyenne", F.col("mean"))))))

    return _each(spark, sf_dir, with_mean)


QUERIES = {f.__name__: f for f in (
    p5_date_window, p6_p7_property_type_and_rooms, p8_projection, p9_address_and_street, p10_exclusion_reason, j2_radius_join, f16_f17_f18_geo, f19_gap_and_decay, w1_time_gap_dedup,
    a3_mad_outliers, w2_ranking, w3_top_ten, c1_similarity, c2_price_premium, a1_statistics, a2_thirds, a4_exact_median, o1_latest_first, p17_display, s2_summary_row,
)}

_TABLES = """
txn AS (SELECT l_extendedprice AS total_price, l_quantity AS living_area, 1 + l_partkey % 5 AS rooms, l_shipdate::DATE AS sale_date,
  CASE WHEN l_partkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type, 'RUE ' || (l_suppkey % 10) AS street, l_partkey % 7 AS number,
  43.0::DOUBLE + (l_partkey % 100000) / 5000.0::DOUBLE AS lat, 2.25::DOUBLE + (l_suppkey % 100) / 1000.0::DOUBLE AS lon, l_quantity * 3 AS land_area FROM lineitem),
subj AS (SELECT c_custkey AS subject_id, 43.0::DOUBLE + (c_custkey % 100000) / 5000.0::DOUBLE AS s_lat, 2.25::DOUBLE + (c_custkey % 100) / 1000.0::DOUBLE AS s_lon,
  CASE WHEN c_custkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type, (20 + c_custkey % 80)::DOUBLE AS s_area, 1 + c_custkey % 5 AS s_rooms,
  (60 + c_custkey % 240)::DOUBLE AS s_land, 'RUE ' || (c_custkey % 10) AS street_name, 500 AS search_radius_m, DATE '1998-09-02' AS valuation_date FROM customer),
box AS (SELECT *, 2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)) AS metres FROM (
  SELECT *, pow(sin(radians(lat - s_lat) / 2), 2) + cos(radians(s_lat)) * cos(radians(lat)) * pow(sin(radians(lon - s_lon) / 2), 2) AS a
  FROM subj JOIN txn USING (property_type)
  WHERE lat BETWEEN s_lat - 500 / 111320 AND s_lat + 500 / 111320
    AND lon BETWEEN s_lon - 500 / (111320 * greatest(abs(cos(radians(s_lat))), 0.1)) AND s_lon + 500 / (111320 * greatest(abs(cos(radians(s_lat))), 0.1)))),
cand AS (SELECT *, number || ' ' || street AS address, living_area AS living_area_sqm, floor(total_price * 100 + 0.5) / 100 AS total_price_eur, land_area AS land_area_sqm,
  floor(floor(total_price * 100 + 0.5) / 100 / living_area * 100 + 0.5) / 100 AS price_per_sqm_eur, floor(metres * 10 + 0.5) / 10 AS distance_m
  FROM box WHERE sale_date BETWEEN DATE '1996-01-01' AND valuation_date)"""
_FOLD = _TABLES + """,
num AS (SELECT *, row_number() OVER (PARTITION BY subject_id, address ORDER BY price_per_sqm_eur DESC, sale_date DESC, total_price, living_area, rooms, lat, lon) AS rn FROM cand),
fold AS (SELECT subject_id, address, rn, sale_date, [sale_date] AS kept, false AS duplicate FROM num WHERE rn = 1
  UNION ALL SELECT n.subject_id, n.address, n.rn, n.sale_date,
    CASE WHEN len(list_filter(f.kept, lambda k: abs(k - n.sale_date) < 730)) > 0 THEN f.kept ELSE list_append(f.kept, n.sale_date) END,
    len(list_filter(f.kept, lambda k: abs(k - n.sale_date) < 730)) > 0
  FROM fold f JOIN num n ON n.subject_id = f.subject_id AND n.address = f.address AND n.rn = f.rn + 1),
flag AS (SELECT num.*, fold.duplicate FROM num JOIN fold USING (subject_id, address, rn))"""
_SCORE = """floor(100 * (
  (CASE WHEN property_type = 'appartement' THEN 22.0 ELSE 24.0 END) * exp(-distance_m / (CASE WHEN property_type = 'appartement' THEN 180.0 ELSE 420.0 END))
  + (CASE WHEN property_type = 'appartement' THEN 8.0 * (CASE WHEN distance_m <= 30 THEN 0.3 ELSE 0 END) ELSE 5.0 * (CASE WHEN distance_m <= 50 THEN 0.25 ELSE 0 END) END)
  + (CASE WHEN property_type = 'appartement' THEN 8.0 * (CASE WHEN distance_m <= 20 THEN 1.0 WHEN distance_m <= 40 THEN 0.65 WHEN distance_m <= 70 THEN 0.3 ELSE 0 END)
     ELSE 4.0 * (CASE WHEN distance_m <= 40 THEN 1.0 WHEN distance_m <= 80 THEN 0.5 ELSE 0 END) END)
  + (CASE WHEN property_type = 'appartement' THEN 24.0 ELSE 22.0 END) * exp(-(abs(living_area_sqm - s_area) / s_area) / (CASE WHEN property_type = 'appartement' THEN 0.14 ELSE 0.18 END))
  + 12.0 * exp(-(valuation_date - sale_date) / (CASE WHEN property_type = 'appartement' THEN 300.0::DOUBLE ELSE 360.0::DOUBLE END))
  + (CASE WHEN property_type = 'appartement' THEN 26.0 ELSE 16.0 END) * (CASE abs(rooms - s_rooms) WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN (CASE WHEN property_type = 'appartement' THEN 0 ELSE 0.05 END) ELSE 0 END)
  + (CASE WHEN property_type = 'appartement' THEN 10.0 ELSE 6.0 END) * exp(-(abs(living_area_sqm / rooms - s_area / s_rooms) / (s_area / s_rooms)) / (CASE WHEN property_type = 'appartement' THEN 0.22 ELSE 0.26 END))
  + (CASE WHEN property_type = 'appartement' THEN 0 ELSE 15.0 * exp(-(abs(land_area_sqm - s_land) / s_land) / 0.28) END)) + 0.5) / 100"""
_COMPARE = _FOLD + f""",
scored AS (SELECT *, {_SCORE} AS score, CASE WHEN distance_m > search_radius_m THEN 'outside_radius' WHEN duplicate THEN 'duplicate_recent_sale' END AS first_reason FROM flag),
cen AS (SELECT subject_id, median(ln(price_per_sqm_eur)) AS centre, count(*) AS n FROM scored WHERE first_reason IS NULL AND price_per_sqm_eur > 0 GROUP BY 1),
mad AS (SELECT subject_id, median(abs(ln(price_per_sqm_eur) - centre)) AS mad FROM scored JOIN cen USING (subject_id) WHERE first_reason IS NULL AND price_per_sqm_eur > 0 GROUP BY 1),
zed AS (SELECT scored.*, CASE WHEN first_reason IS NULL AND n >= 5 AND mad >= 1e-6 THEN (ln(price_per_sqm_eur) - centre) / (1.4826 * mad) END AS exact_z
  FROM scored LEFT JOIN cen USING (subject_id) LEFT JOIN mad USING (subject_id)),
done AS (SELECT *, round(exact_z, 3) AS z, CASE WHEN first_reason IS NOT NULL THEN first_reason
   WHEN exact_z < (CASE WHEN property_type = 'appartement' THEN -2.2 ELSE -2.0 END) THEN 'price_outlier_low'
   WHEN exact_z > (CASE WHEN property_type = 'appartement' THEN 2.2 ELSE 3.6 END) THEN 'price_outlier_high' END AS reason FROM zed),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY reason IS NOT NULL, score DESC, sale_date DESC, distance_m, price_per_sqm_eur, total_price_eur, living_area_sqm, rooms, address, lat, lon) AS place FROM done)"""


def _french(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN abs(round({x}, 2) - round({x})) < 1e-9 THEN replace(format('{{:,}}', round({x})::BIGINT), ',', ' ')
      ELSE regexp_replace(replace(replace(format('{{:,.2f}}', round({x}, 2)), ',', ' '), '.', ','), '0$', '') END"""


SQL = {
    "p5_date_window": f"""WITH {_TABLES}, s AS (SELECT *, CASE WHEN subject_id % 4 = 0 THEN DATE '1996-01-01' ELSE DATE '1997-01-02' END AS start FROM box)
      SELECT subject_id, count(*) AS n, min(sale_date)::VARCHAR AS first, max(sale_date)::VARCHAR AS last FROM s WHERE sale_date BETWEEN start AND valuation_date GROUP BY 1""",
    "p6_p7_property_type_and_rooms": """WITH raw AS (SELECT CASE l_partkey % 5 WHEN 0 THEN 'appartement' WHEN 1 THEN 'maison'
        ELSE CASE WHEN l_suppkey % 3 > 0 AND l_linenumber % 2 = 0 THEN 'appartement' WHEN l_linenumber % 2 > 0 AND l_suppkey % 3 = 0 THEN 'maison'
             WHEN l_quantity % 2 > 0 AND l_quantity % 3 <= 0 THEN 'appartement' WHEN l_quantity % 3 > 0 AND l_quantity % 2 <= 0 THEN 'maison' END END AS kind,
        CASE WHEN l_partkey % 4 = 0 AND l_linenumber > 2 THEN l_linenumber - 2 WHEN l_partkey % 4 = 1 THEN 3 END AS main,
        [(l_partkey % 3 = 0)::INT, (l_suppkey % 5 = 0)::INT, 0, (l_orderkey % 7 = 0)::INT, 0] AS c FROM lineitem)
      SELECT kind, coalesce(main, CASE WHEN kind IS NOT NULL AND list_sum(c) = 1 THEN list_position(c, 1) END)::INT AS rooms, count(*) AS n FROM raw GROUP BY 1, 2""",
    "p8_projection": f"WITH {_TABLES} SELECT subject_id, count(*) AS n, round(sum(price_per_sqm_eur), 2) AS price_m2, round(sum(distance_m), 1) AS metres, round(sum(land_area_sqm), 2) AS land FROM cand GROUP BY 1",
    "p9_address_and_street": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'Label ' || o_custkey
        ELSE (o_custkey % 20) || CASE WHEN o_orderkey % 3 > 0 THEN ' RUE' ELSE '' END || ' ' || o_orderstatus END AS address,
        CASE WHEN o_orderkey % 7 = 0 THEN 'Quai Haut' WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE o_orderpriority END AS street FROM orders""",
    "p10_exclusion_reason": f"WITH RECURSIVE {_FOLD} SELECT subject_id, CASE WHEN distance_m > search_radius_m THEN 'outside_radius' WHEN duplicate THEN 'duplicate_recent_sale' END AS reason, count(*) AS n FROM flag GROUP BY 1, 2",
    "j2_radius_join": f"WITH {_TABLES} SELECT subject_id, count(*) AS n, round(sum(metres), 3) AS metres FROM box WHERE metres <= search_radius_m GROUP BY 1",
    "f16_f17_f18_geo": f"""WITH {_TABLES}, g AS (SELECT *, pow(sin(radians(48.85 - s_lat) / 2), 2) + cos(radians(s_lat)) * cos(radians(48.85)) * pow(sin(radians(2.35 - s_lon) / 2), 2) AS a FROM subj)
      SELECT subject_id, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres, round(500 / 111320, 8) AS dlat,
        round(500 / (111320 * greatest(abs(cos(radians(s_lat))), 0.1)), 8) AS dlon, round(s_lon + 0.005, 8) AS centre_lon, round(s_lat + 0.01, 8) AS centre_lat FROM g""",
    "f19_gap_and_decay": """WITH g AS (SELECT CASE WHEN l_quantity > 10 THEN abs(l_linenumber * 5.0 - (l_quantity - 10)) / (l_quantity - 10) END AS g FROM lineitem)
      SELECT round(g, 6) AS gap, round(exp(-g / 0.14), 6) AS decay, count(*) AS n FROM g GROUP BY 1, 2""",
    "w1_time_gap_dedup": f"WITH RECURSIVE {_FOLD} SELECT subject_id, address, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT duplicate) AS kept FROM flag GROUP BY 1, 2",
    "a3_mad_outliers": f"WITH RECURSIVE {_COMPARE} SELECT subject_id, count(*) FILTER (reason = 'price_outlier_low') AS low, count(*) FILTER (reason = 'price_outlier_high') AS high, round(sum(z), 3) AS z FROM done WHERE z IS NOT NULL GROUP BY 1",
    "w2_ranking": f"WITH RECURSIVE {_COMPARE} SELECT subject_id, max(place)::INT AS places, (max(place) FILTER (reason IS NULL))::INT AS last_retained, max(score) FILTER (place = 1) AS best_score FROM placed GROUP BY 1",
    "w3_top_ten": f"WITH RECURSIVE {_COMPARE} SELECT subject_id, place::INT AS place, score, address, price_per_sqm_eur, distance_m FROM placed WHERE place <= 10",
    "c1_similarity": f"WITH {_TABLES}, s AS (SELECT *, {_SCORE} AS score FROM cand) SELECT subject_id, count(*) AS n, round(sum(score), 2) AS total, max(score) AS best, min(score) AS least FROM s GROUP BY 1",
    "c2_price_premium": """WITH r AS (SELECT o_totalprice / 150000 AS r FROM orders)
      SELECT CASE WHEN r >= 1.2 THEN 15 WHEN r >= 1.1 THEN 10 WHEN r >= 1.0 THEN 5 ELSE 0 END AS bonus,
        CASE WHEN r <= 0.5 THEN -18 WHEN r <= 0.6 THEN -12 WHEN r <= 0.7 THEN -8 WHEN r <= 0.8 THEN -4 ELSE 0 END AS penalty, count(*) AS n FROM r GROUP BY 1, 2""",
    "a1_statistics": f"""WITH RECURSIVE {_COMPARE} SELECT subject_id, count(*) AS found, count(*) FILTER (reason IS NULL) AS retained, count(*) FILTER (reason IS NOT NULL) AS excluded,
      floor(sum(floor(total_price_eur * 100 + 0.5)::BIGINT) FILTER (reason IS NULL) / count(total_price_eur) FILTER (reason IS NULL) + 0.5) / 100 AS average_total_price, min(price_per_sqm_eur) FILTER (reason IS NULL) AS min_price_m2,
      floor(median(floor(price_per_sqm_eur * 100 + 0.5)::BIGINT) FILTER (reason IS NULL) + 0.5) / 100 AS median_price_m2, max(price_per_sqm_eur) FILTER (reason IS NULL) AS max_price_m2,
      floor(sum(floor(price_per_sqm_eur * 100 + 0.5)::BIGINT) FILTER (reason IS NULL) / count(price_per_sqm_eur) FILTER (reason IS NULL) + 0.5) / 100 AS average_price_m2 FROM done GROUP BY 1""",
    "a2_thirds": f"""WITH RECURSIVE {_COMPARE}, t AS (SELECT subject_id, price_per_sqm_eur AS p, ntile(3) OVER (PARTITION BY subject_id ORDER BY price_per_sqm_eur) AS band FROM done WHERE reason IS NULL)
      SELECT subject_id, floor(sum(floor(p * 100 + 0.5)::BIGINT) FILTER (band = 1) / count(p) FILTER (band = 1) + 0.5) / 100 AS low_band, floor(sum(floor(p * 100 + 0.5)::BIGINT) FILTER (band = 2) / count(p) FILTER (band = 2) + 0.5) / 100 AS mid_band, floor(sum(floor(p * 100 + 0.5)::BIGINT) FILTER (band = 3) / count(p) FILTER (band = 3) + 0.5) / 100 AS high_band FROM t GROUP BY 1""",
    "a4_exact_median": "SELECT o_custkey, median(o_totalprice) AS median FROM orders GROUP BY 1",
    "o1_latest_first": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate::DATE END DESC NULLS LAST, o_orderkey)::INT AS place FROM orders",
    "p17_display": f"""WITH RECURSIVE {_COMPARE} SELECT subject_id, place::INT AS place, CASE WHEN reason IS NULL THEN 'Oui' ELSE 'Non' END AS retenu, {_french('score')} AS score, {_french('living_area_sqm')} AS surface,
      strftime(sale_date, '%d/%m/%Y') AS date_vente, {_french('total_price_eur')} AS prix, {_french('price_per_sqm_eur')} AS prix_m2 FROM placed""",
    "s2_summary_row": f"""WITH RECURSIVE {_COMPARE}, t AS (SELECT subject_id, place::INT AS place, price_per_sqm_eur AS p FROM placed WHERE place <= 10)
      SELECT subject_id, place, 'Vente' AS label, p AS price_m2 FROM t UNION ALL SELECT subject_id, NULL, 'Moyenne', floor(sum(floor(p * 100 + 0.5)::BIGINT) / count(p) + 0.5) / 100 FROM t GROUP BY 1""",
}
