"""Queries on price quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.functions import labels
from cadaster.operators import quotes as q
from cadaster.sources.views import table


def _places(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS subject_id", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('Ville', c_custkey % 7) END AS city", "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE cast(10000 + c_custkey % 90000 AS string) END AS postcode",
        "CASE WHEN c_custkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type")


def _raw(spark, sf_dir):
    """Replies of four sources for each customer: price blocks, flat prices, land prices, errors."""
    rows = table(spark, sf_dir, "customer").withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(4)))))
    block = lambda kind, add: f"named_struct('type_bien', {kind}, 'prix_m2_min', cast(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 8000 + c_custkey % 500 + {add} END AS double), 'prix_m2_moyen', cast(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 9000 + c_custkey % 500 + {add} END AS double), 'prix_m2_max', cast(10000 + c_custkey % 400 + {add} AS double))"
    blocks = f"CASE WHEN i < 2 THEN CASE c_custkey % 4 WHEN 0 THEN array({block("'maison'", 0)}, {block("'appartement'", 100)}) WHEN 1 THEN array({block("'terrain'", 0)}) WHEN 2 THEN array({block("'autre'", 7)}, {block("'Maison '", 9)}) END END"
    return rows.selectExpr(
        f"element_at(array({', '.join(repr(s) for s in q.SOURCES)}), i + 1) AS source", "c_custkey AS subject_id", "CASE WHEN c_custkey % 2 = 0 THEN 'appartement' WHEN c_custkey % 5 > 0 THEN 'maison' END AS property_type",
        f"{blocks} AS prix", "CASE WHEN i = 3 THEN 8700.0D + c_custkey % 10 END AS tranche_basse", "CASE WHEN i = 3 THEN 9400.0D WHEN i = 2 AND c_custkey % 6 > 0 THEN 3500.0D END AS prix_m2_moyen", "CASE WHEN i = 3 THEN 10100.0D END AS tranche_haute",
        "CASE WHEN c_custkey % 10 = 9 THEN 'page introuvable' END AS error", "CASE WHEN c_custkey % 15 = 7 THEN ' Skipped ' END AS status")


def p18_source_requests(spark, sf_dir):
    return q.requests(_places(spark, sf_dir)).groupBy("source", "property_type", "status").agg(F.count("*").alias("n"))


def p15_p16_normalised_quotes(spark, sf_dir):
    return q.normalise(_raw(spark, sf_dir))


def a5_quote_summary(spark, sf_dir):
    return q.summary(q.normalise(_raw(spark, sf_dir)), "source")


def s1_quotes_with_average(spark, sf_dir):
    return q.with_average(q.normalise(_raw(spark, sf_dir)))


def s3_missing_types(spark, sf_dir):
    return q.missing_types(q.normalise(_raw(spark, sf_dir)), ["appartement", "maison", "terrain"])


def s4_ordered_union(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(o_orderstatus, substring(o_orderpriority, 1, 1), o_orderstatus) AS a", "array(substring(o_orderpriority, 1, 1), 'F', cast(o_custkey % 6 AS string)) AS b")
    return rows.select("o_orderkey", F.array_join(q.ordered_union(F.col("a"), F.col("b")), ",").alias("all"))


def src8_latest_snapshots(spark, sf_dir):
    return q.latest(table(spark, sf_dir, "events").selectExpr("user_id AS key", "ts AS cached_at", "props AS payload"))


def _prices(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    level = lambda name, code, every: rows.selectExpr(f"'{name}' AS level", f"{code} AS code", "s_acctbal AS price", "s_suppkey").withColumn("code", F.expr(f"CASE WHEN s_suppkey % {every} = 0 THEN code ELSE concat('x', code) END")).groupBy("level", "code").agg(F.max("price").alias("price"))
    return level("district", "concat('d', cast(floor(s_suppkey / 3) AS int))", 3).unionByName(level("city", "concat('c', cast(floor(s_suppkey / 8) AS int))", 2)).unionByName(level("department", "concat('p', cast(floor(s_suppkey / 16) AS int))", 1)), level


def j16_price_fallback(spark, sf_dir):
    prices, _ = _prices(spark, sf_dir)
    places = table(spark, sf_dir, "customer").selectExpr("c_custkey AS place_id", "concat('d', cast(floor(c_custkey / 30) AS int)) AS district", "concat('c', cast(floor(c_custkey / 90) AS int)) AS city", "concat('p', cast(floor(c_custkey / 200) AS int)) AS department")
    return q.with_fallback(places, prices)


def j17_finest_location(spark, sf_dir):
    prices, level = _prices(spark, sf_dir)
    prices = prices.withColumn("level", F.when(F.col("level") == "city", "commune").otherwise(F.col("level"))).unionByName(level("block", "concat('b', cast(floor(s_suppkey / 2) AS int))", 7))
    places = table(spark, sf_dir, "customer").selectExpr("c_custkey AS place_id", "array(concat('b', cast(floor(c_custkey / 24) AS int)), concat('d', cast(floor(c_custkey / 30) AS int)), concat('c', cast(floor(c_custkey / 90) AS int)), concat('p', cast(floor(c_custkey / 200) AS int)), 'fr') AS codes")
    return q.finest(places, prices)


def a20_o4_distinct_suggestions(spark, sf_dir):
    """Distinct labels of each customer, the first kept, five at most."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "lower(trim(o_orderpriority)) AS label")
    kept = q.first_per_key(rows, ["o_custkey", "label"], ["o_orderkey"])
    return kept.withColumn("place", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")).where("place <= least(greatest(5, 1), 15)").select("o_custkey", "label", "place")


def o3_catalogue_order(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("department", labels.department(F.format_string("%05d", F.col("s_suppkey") * 931)))
    return rows.selectExpr("s_suppkey", "department", "row_number() OVER (PARTITION BY department ORDER BY lower(s_name), s_suppkey) AS place")


QUERIES = {f.__name__: f for f in (p18_source_requests, p15_p16_normalised_quotes, a5_quote_summary, s1_quotes_with_average, s3_missing_types, s4_ordered_union, src8_latest_snapshots, j16_price_fallback, j17_finest_location, a20_o4_distinct_suggestions, o3_catalogue_order)}

_SRC = "['consortium_immobilier', 'lesclesdumidi', 'terrain_construction', 'meilleursagents']"


def _block(kind: str, add: int) -> str:
    return f"{{'type_bien': {kind}, 'lo': (CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 8000 + c_custkey % 500 + {add} END)::DOUBLE, 'mi': (CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 9000 + c_custkey % 500 + {add} END)::DOUBLE, 'hi': (10000 + c_custkey % 400 + {add})::DOUBLE}}"


_QUOTES = f"""
r AS (SELECT c_custkey, i, CASE WHEN c_custkey % 2 = 0 THEN 'appartement' WHEN c_custkey % 5 > 0 THEN 'maison' END AS kind,
  CASE WHEN i < 2 THEN CASE c_custkey % 4 WHEN 0 THEN [{_block("'maison'", 0)}, {_block("'appartement'", 100)}] WHEN 1 THEN [{_block("'terrain'", 0)}] WHEN 2 THEN [{_block("'autre'", 7)}, {_block("'Maison '", 9)}] END END AS prix
  FROM customer, range(4) t(i)),
p AS (SELECT *, coalesce([b for b in prix if lower(trim(b.type_bien)) = kind][1], CASE WHEN len(prix) = 1 THEN prix[1] END, [b for b in prix if coalesce(b.lo, b.mi, b.hi) IS NOT NULL][1]) AS b FROM r),
n AS (SELECT {_SRC}[i + 1] AS source, c_custkey AS subject_id, coalesce(kind, b.type_bien) AS property_type,
  coalesce(CASE WHEN i = 3 THEN 8700.0 + c_custkey % 10 END, b.lo)::DOUBLE AS low, coalesce(CASE WHEN i = 3 THEN 9400.0 WHEN i = 2 AND c_custkey % 6 > 0 THEN 3500.0 END, b.mi)::DOUBLE AS mid, coalesce(CASE WHEN i = 3 THEN 10100.0 END, b.hi)::DOUBLE AS high,
  CASE WHEN c_custkey % 10 = 9 THEN 'page introuvable' END AS error, c_custkey FROM p),
q AS (SELECT source, subject_id, property_type, low, mid, high, error, CASE WHEN c_custkey % 15 = 7 THEN 'skipped' WHEN error IS NOT NULL THEN 'error' WHEN coalesce(low, mid, high) IS NOT NULL THEN 'ok' ELSE 'empty' END AS status FROM n)"""


def _mean(c: str) -> str:
    return f"floor(sum(floor({c} * 100 + 0.5)::BIGINT) FILTER (status = 'ok') / count({c}) FILTER (status = 'ok') + 0.5) / 100"


_PRICES = """
pr AS (SELECT 'district' AS level, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'x' END || 'd' || (cast(floor(s_suppkey / 3) AS int)) AS code, max(s_acctbal) AS price FROM supplier GROUP BY ALL
  UNION ALL SELECT 'city', CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END || 'c' || (cast(floor(s_suppkey / 8) AS int)), max(s_acctbal) FROM supplier GROUP BY ALL
  UNION ALL SELECT 'department', 'p' || (cast(floor(s_suppkey / 16) AS int)), max(s_acctbal) FROM supplier GROUP BY ALL)"""

SQL = {
    "p18_source_requests": f"""SELECT source, property_type, status, count(*) AS n FROM (SELECT source, property_type, CASE WHEN source = 'terrain_construction' AND property_type <> 'maison' THEN 'skipped'
      WHEN source <> 'meilleursagents' AND (c % 11 = 0 OR c % 13 = 0) THEN 'error' END AS status FROM (SELECT c_custkey AS c, unnest({_SRC}) AS source, CASE WHEN c_custkey % 2 = 0 THEN 'appartement' ELSE 'maison' END AS property_type FROM customer)) GROUP BY ALL""",
    "p15_p16_normalised_quotes": f"WITH {_QUOTES} SELECT * FROM q",
    "a5_quote_summary": f"""WITH {_QUOTES} SELECT source, count(*) AS total, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'empty') AS n_empty, count(*) FILTER (status = 'skipped') AS n_skipped,
      {_mean('low')} AS low, {_mean('mid')} AS mid, {_mean('high')} AS high, min(mid) FILTER (status = 'ok') AS min_mid, max(mid) FILTER (status = 'ok') AS max_mid FROM q GROUP BY 1""",
    "s1_quotes_with_average": f"""WITH {_QUOTES} SELECT subject_id, source, low, mid, high, status FROM q
      UNION ALL SELECT subject_id, 'Moyenne globale', {_mean('low')}, {_mean('mid')}, {_mean('high')}, 'synthese' FROM q GROUP BY 1""",
    "s3_missing_types": f"""WITH {_QUOTES}, f AS (SELECT subject_id, coalesce(list(DISTINCT property_type) FILTER (status = 'ok'), []) AS f FROM q GROUP BY 1)
      SELECT subject_id, array_to_string([t for t in ['appartement', 'maison', 'terrain'] if NOT list_contains(f, t)], ',') AS missing FROM f""",
    "s4_ordered_union": """SELECT o_orderkey, array_to_string([x for x, i in l if list_position(l, x) = i], ',') AS all FROM (SELECT o_orderkey, [o_orderstatus, o_orderpriority[1], o_orderstatus, o_orderpriority[1], 'F', (o_custkey % 6)::VARCHAR] AS l FROM orders)""",
    "src8_latest_snapshots": "SELECT user_id AS key, ts AS cached_at, props AS payload FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) = 1",
    "j16_price_fallback": f"""WITH {_PRICES} SELECT c_custkey AS place_id, coalesce(a.price, b.price, c.price) AS price, CASE WHEN a.price IS NOT NULL THEN 'district' WHEN b.price IS NOT NULL THEN 'city' WHEN c.price IS NOT NULL THEN 'department' END AS fallback_level
      FROM customer LEFT JOIN pr a ON a.level = 'district' AND a.code = 'd' || (cast(floor(c_custkey / 30) AS int)) LEFT JOIN pr b ON b.level = 'city' AND b.code = 'c' || (cast(floor(c_custkey / 90) AS int)) LEFT JOIN pr c ON c.level = 'department' AND c.code = 'p' || (cast(floor(c_custkey / 200) AS int))""",
    "j17_finest_location": f"""WITH {_PRICES}, al AS (SELECT CASE level WHEN 'city' THEN 'commune' ELSE level END AS level, code, price FROM pr UNION ALL SELECT 'block', CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'x' END || 'b' || (cast(floor(s_suppkey / 2) AS int)), max(s_acctbal) FROM supplier GROUP BY ALL),
      l AS (SELECT c_custkey AS place_id, unnest([1, 2, 3, 4, 5]) AS rank, unnest(['block', 'district', 'commune', 'department', 'country']) AS level, unnest(['b' || (cast(floor(c_custkey / 24) AS int)), 'd' || (cast(floor(c_custkey / 30) AS int)), 'c' || (cast(floor(c_custkey / 90) AS int)), 'p' || (cast(floor(c_custkey / 200) AS int)), 'fr']) AS code FROM customer)
      SELECT place_id, level, code, price FROM l JOIN al USING (level, code) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rank) = 1""",
    "a20_o4_distinct_suggestions": """WITH f AS (SELECT o_custkey, lower(trim(o_orderpriority)) AS label, min(o_orderkey) AS k FROM orders GROUP BY ALL), n AS (SELECT o_custkey, label, row_number() OVER (PARTITION BY o_custkey ORDER BY k)::INT AS place FROM f) SELECT * FROM n WHERE place <= 5""",
    "o3_catalogue_order": """WITH d AS (SELECT s_suppkey, s_name, printf('%05d', s_suppkey * 931) AS p FROM supplier), e AS (SELECT *, CASE WHEN p[1:3] IN ('971', '972', '973', '974', '976') THEN p[1:3] WHEN p LIKE '20%' THEN CASE WHEN try_cast(p AS INT) <= 20190 THEN '2A' WHEN try_cast(p AS INT) > 20190 THEN '2B' END ELSE p[1:2] END AS department FROM d)
      SELECT s_suppkey, department, row_number() OVER (PARTITION BY department ORDER BY lower(s_name), s_suppkey)::INT AS place FROM e""",
}
