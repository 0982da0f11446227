"""Queries on table grids, statement pages and price harvesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.operators import grids as g
from cadaster.plans.scalars import canonical
from cadaster.sources.views import table


def _holdings(spark, sf_dir):
    """A property table for each order key: a title row for some, a header, rows of lots, a total row."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "struct(l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS o", "array(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('APT', l_partkey % 3) END, concat(l_suppkey, ' RUE'), cast(cast(l_quantity AS int) AS string), CASE WHEN l_partkey % 4 = 0 THEN concat('(', l_suppkey, ' 000 €)') ELSE concat(l_suppkey, ' 000 €') END, CASE WHEN l_linenumber % 2 = 0 THEN 'CP' ELSE cast(l_linenumber AS string) END) AS r")
    body = rows.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("body"))
    head = F.when(F.col("doc_id") % 3 == 0, F.expr("array(array('Patrimoine immobilier', '', '', '', ''), array('Type de bien (1)', 'Adresse et destination (2)', 'Surface habitable', 'Estimation actuelle', 'Capital restant dû'))")).when(F.col("doc_id") % 3 == 1, F.expr("array(array('Type de bien', 'Adresse', 'Surface', 'Estimation actuelle', 'Capital restant dû'))")).otherwise(F.expr("array(array('a', 'b', 'c', 'd', 'e'))"))
    total = F.expr("array(array('', '', '10', '1 000', '2'))")
    return body.select("doc_id", F.concat(head, "body", total).alias("cells"))


def p23_header_records(spark, sf_dir):
    return g.header_records(_holdings(spark, sf_dir)).select("doc_id", "row", "type_bien", "adresse", "surface", "estimation_actuelle", "capital_restant_du")


def a22_holding_totals(spark, sf_dir):
    return g.holdings(g.header_records(_holdings(spark, sf_dir)))


def p24_value_columns(spark, sf_dir):
    number = "CASE WHEN l_partkey % 5 > 0 THEN concat(l_suppkey, ' 000') ELSE 'n.c.' END"
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", f"array('Ligne', '', CASE WHEN l_partkey % 5 > 0 THEN '7' ELSE '' END, {number}, CASE WHEN l_linenumber % 2 > 0 THEN {number} ELSE '-' END) AS r")
    head = F.array(F.array(*(F.lit(x) for x in ("2020", "2021", "2022", "2023", "2024"))))
    return g.value_columns(rows.groupBy("doc_id").agg(F.concat(head, F.collect_list("r")).alias("cells")))


def w17_main_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS doc_id", "cast(l_linenumber AS int) AS table_idx", "array(CASE l_partkey % 6 WHEN 0 THEN 'Total actif' WHEN 1 THEN 'Créances clients' WHEN 2 THEN 'Disponibilités' ELSE 'Divers' END, CASE WHEN l_partkey % 5 > 0 THEN cast(l_partkey AS string) ELSE '' END, CASE WHEN l_orderkey % 2 = 0 THEN 'x' END) AS r")
    tables = rows.groupBy("doc_id", "table_idx").agg(F.collect_list("r").alias("cells"))
    return g.main_table(tables, "bilan_actif").select("doc_id", "hits", "numbers")


def _pages(spark, sf_dir):
    """Pages of statements: documents in sixes, titles, contents and lines with numbers by number."""
    d = table(spark, sf_dir, "documents")
    title = F.expr("CASE doc_id % 7 WHEN 0 THEN 'BILAN  ACTIF' WHEN 1 THEN 'Compte de résultat (suite)' WHEN 2 THEN 'actif immobilisé' WHEN 3 THEN 'Bilan passif' WHEN 4 THEN 'Compte de resultat' WHEN 5 THEN 'Voir le bilan actif en annexe' ELSE 'Notes' END")
    content = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Actif circulant' WHEN 1 THEN 'chiffre d\\'affaires, charges d\\'exploitation' WHEN 2 THEN 'capital social, report à nouveau, résultat de l\\'exercice' ELSE 'capital social, report à nouveau' END")
    more = F.expr("CASE WHEN doc_id % 17 = 5 THEN array('Notes sur le bilan') WHEN n_chars % 22 = 0 THEN array('12 et 7') ELSE transform(sequence(1, cast(n_chars % 22 AS int)), i -> concat('Ligne ', i, '\u00a0000')) END")
    return d.select((F.floor(F.col("doc_id") / 6)).alias("doc_id"), (F.col("doc_id") % 6 + 1).cast("int").alias("page"), F.concat(F.array(F.lit("page"), title, content), more).alias("lines"))


def _page_tables(spark, sf_dir):
    """A table on every third of those pages, of up to fourteen rows, and on some a second."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").withColumn("table_idx", F.explode(F.expr("CASE WHEN doc_id % 5 = 0 THEN array(0, 1) ELSE array(0) END")))
    row = "array(CASE (i + table_idx) % 4 WHEN 0 THEN 'Créances' WHEN 1 THEN 'Capital social' WHEN 2 THEN 'Impôts et taxes' ELSE 'Divers' END, cast(i * 7 AS string))"
    cells = F.expr(f"transform(sequence(1, cast((n_chars + 3 * table_idx) % 14 + 1 AS int)), i -> {row})")
    return d.select(F.floor(F.col("doc_id") / 6).alias("doc_id"), (F.col("doc_id") % 6 + 1).cast("int").alias("page"), "table_idx", cells.alias("cells"))


def p22_statement_pages(spark, sf_dir):
    return g.statement_pages(_pages(spark, sf_dir))


def w16_section_scores(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumn("section", F.explode(F.lit(list(g.TITLES))))
    return g.section_scores(pages, _page_tables(spark, sf_dir))


def w16_page_spans(spark, sf_dir):
    return g.page_spans(_pages(spark, sf_dir), _page_tables(spark, sf_dir), 3)


_GRID_ROW = """CASE l_partkey % 13 WHEN 0 THEN array('Actif immobilisé', '', '', '') WHEN 1 THEN array('Emprunts', NULL, '', '') WHEN 2 THEN array('dont  concours bancaires', '', concat('(', l_suppkey, '\u00a0000)'), cast(l_linenumber AS string))
 WHEN 3 THEN array('du 01/01/2020 au 31/12/2020', '', '', '') WHEN 4 THEN array('', '', concat(l_suppkey, ' 000'), concat(l_linenumber, ',50')) WHEN 5 THEN array('- à long terme', '', '', 'n.c.') WHEN 6 THEN array('Dettes\n fournisseurs :', '', '', cast(l_suppkey AS string))
 WHEN 7 THEN array('BRUT', '', 'NET', '') WHEN 8 THEN array(concat('Ligne ', l_suppkey, 'x'), '', cast(l_suppkey AS string), cast(l_linenumber AS string)) WHEN 9 THEN array('Terrains', '', '', '') WHEN 10 THEN array('- divers', '', '', cast(l_linenumber AS string))
 WHEN 11 THEN array('Total |', '', '12', '7') ELSE array('12 €', '', '', '') END"""


def w15_logical_rows(spark, sf_dir):
    """An account grid for each order: its items are rows with amounts, labels that wait for them, headings."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "struct(l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS o", f"{_GRID_ROW} AS r").repartition("doc_id")
    body = F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])
    head = F.array(F.array(*(F.lit(x) for x in ("Poste", "", "2021", "2020"))))
    return g.logical_rows(rows.groupBy("doc_id").agg(F.concat(head, body).alias("cells")))


def a21_lot_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS project_id", "concat('L', l_orderkey, '-', l_linenumber) AS lot", "cast(l_quantity AS long) AS area", "cast(floor(l_extendedprice) AS long) AS price", "cast(l_partkey % 1000 AS long) AS deposit")
    return g.with_totals(rows, "project_id", "lot", ["area", "price", "deposit"])


def x1_price_pages(spark, sf_dir):
    page = F.expr("CASE o_orderkey % 5 WHEN 0 THEN concat('Bien : ', 3000 + o_custkey, ' €/m² environ') WHEN 1 THEN concat('prix au m2 : ', 4, ' ', 100 + o_custkey % 900, ' €') WHEN 2 THEN concat('12 € / m² ; basse 2', 10 + o_custkey % 90, ' 000 € moyenne 300 000 € haute : 350 500 €') WHEN 3 THEN 'rien' ELSE concat('estimation haute 99 € puis haut de 1', 100000 + o_custkey, ' €') END")
    h = g.harvest(page, F.col("o_custkey") % 120)
    return table(spark, sf_dir, "orders").select("o_orderkey", h["m2"].alias("m2"), h["low"].alias("low"), h["high"].alias("high"))


def x2_price_replies(spark, sf_dir):
    data = F.expr("CASE o_orderkey % 4 WHEN 0 THEN to_json(named_struct('valuation', named_struct('avg_price', 1000 + o_custkey, 'x', array(named_struct('minPrice', 600 + o_custkey), named_struct('minPrice', 501))))) WHEN 1 THEN to_json(named_struct('max', 700 + o_custkey, 'deep', named_struct('max', 800, 'mean', 20))) WHEN 2 THEN 'pas du json' ELSE '[1, 2]' END")
    return g.harvest_json(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), data.alias("data")))


def x3_price_tables(spark, sf_dir):
    row = lambda kind, add: f"'<tr><td>1</td><td><b>{kind}</b></td><td>', 2000 + o_custkey + {add}, ' €</td><td class=\"m\">3 ', 100 + o_custkey % 800, ' €</td><td>', CASE WHEN o_orderkey % 3 = 0 THEN 'n.c.' ELSE '5 000 €' END, '</td></tr>'"
    html = F.expr(f"concat('<table><tr><th>Type</th></tr>', {row('Appartement', 0)}, CASE WHEN o_orderkey % 2 = 0 THEN concat({row('Maison  de ville', 7)}) ELSE '' END, '<tr><td>x</td></tr></table>')")
    return g.price_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), html.alias("html")))


def x4_land_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS url", "'Tourcoing' AS city", "CASE o_orderkey % 4 WHEN 0 THEN array('x', concat('Prix moyen du terrain constructible en France : ', 100 + o_custkey, ',5 €/m²')) WHEN 1 THEN array('TOURCOING (59200)', 'a', concat('1 ', 100 + o_custkey % 800, ' € / m2'), concat('Calculé sur ', o_custkey, ' terrains à vendre')) WHEN 2 THEN array('Tourcoing', 'a', 'b', 'c', '99 €/m²') ELSE array('Lille', '88 €/m²') END AS lines")
    return g.land_prices(rows)


QUERIES = {f.__name__: f for f in (p23_header_records, a22_holding_totals, p24_value_columns, w17_main_tables, p22_statement_pages, w16_section_scores, w16_page_spans, w15_logical_rows, a21_lot_totals, x1_price_pages, x2_price_replies, x3_price_tables, x4_land_prices)}

_BODY = """
li AS (SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity AS q, l_extendedprice AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'A' END, l_quantity) AS rn FROM lineitem),
rc AS (SELECT doc_id, (rn + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::INT AS row, CASE WHEN p % 5 > 0 THEN 'APT' || (p % 3) END AS type_bien, s || ' RUE' AS adresse, floor(q)::DOUBLE AS surface, s * 1000.0::DOUBLE * CASE WHEN p % 4 = 0 THEN -1 ELSE 1 END AS estimation_actuelle, CASE WHEN n % 2 > 0 THEN n::DOUBLE END AS capital_restant_du FROM li WHERE doc_id % 3 < 2)"""
_PAGES = """
pg AS (SELECT doc_id // 6 AS doc_id, (doc_id % 6 + 1)::INT AS page, doc_id % 7 AS t, doc_id % 4 AS c, n_chars % 22 AS n, doc_id % 17 = 5 AS notes, doc_id AS d, n_chars AS chars FROM documents),
ti AS (SELECT doc_id, CASE t WHEN 0 THEN 'bilan_actif' WHEN 3 THEN 'bilan_passif' ELSE 'compte_resultat' END AS section, min(page) AS page FROM pg WHERE t IN (0, 3, 4) AND NOT notes GROUP BY ALL),
fr AS (SELECT * FROM pg ANTI JOIN ti USING (doc_id, page)),
co AS (SELECT doc_id, CASE c WHEN 0 THEN 'bilan_actif' WHEN 1 THEN 'compte_resultat' ELSE 'bilan_passif' END AS section, min(page) AS page FROM fr WHERE t <> 1 AND NOT notes AND (c = 1 OR c = 2 OR (c = 0 AND t = 2)) GROUP BY ALL),
st AS (SELECT * FROM ti UNION ALL SELECT * FROM co ANTI JOIN ti USING (doc_id, section))"""

# what the pages say of each section, what their tables hold, and lines with numbers
_SCORES = """
tr AS (SELECT d, i AS idx, (chars + 3 * i) % 14 + 1 AS rows, unnest(range(1, (chars + 3 * i) % 14 + 2)) AS j FROM (SELECT d, chars, unnest(CASE WHEN d % 5 = 0 THEN [0, 1] ELSE [0] END) AS i FROM pg WHERE d % 3 = 0)),
th AS (SELECT d, idx, rows, section, count(DISTINCT (j + idx) % 4) FILTER ((j + idx) % 4 = CASE section WHEN 'bilan_actif' THEN 0 WHEN 'bilan_passif' THEN 1 ELSE 2 END) AS hits FROM tr, (SELECT unnest(['bilan_actif', 'bilan_passif', 'compte_resultat']) AS section) GROUP BY ALL),
tm AS (SELECT d, section, rows FROM th QUALIFY row_number() OVER (PARTITION BY d, section ORDER BY hits DESC, rows DESC, idx) = 1),
ks AS (SELECT pg.*, section, CASE section WHEN 'bilan_actif' THEN (t = 2)::INT + (c = 0)::INT WHEN 'bilan_passif' THEN CASE c WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END ELSE CASE WHEN c = 1 THEN 2 ELSE 0 END END AS said FROM pg, (SELECT unnest(['bilan_actif', 'bilan_passif', 'compte_resultat']) AS section)),
sc AS (SELECT doc_id, ks.section, page, (CASE WHEN notes THEN -10 ELSE 2 * said + (n >= 8)::INT + (n >= 18)::INT + CASE WHEN tm.rows IS NULL THEN 0 ELSE 3 + least(tm.rows, 12) // 4 END END)::INT AS score FROM ks LEFT JOIN tm ON tm.d = ks.d AND tm.section = ks.section)"""
_LAND = "(?i)(\\d{1,4}(?:\\s?\\d{3})*(?:[.,]\\d+)?)\\s*€\\s*/\\s*m[²2]"


def _first(pattern: str, low: int, high: int) -> str:
    """The first number of a page that a pattern finds within limits."""
    return f"[v for v in [try_cast(regexp_replace(x, '\\s', '', 'g') AS DOUBLE) for x in regexp_extract_all(page, '{pattern}', 1)] if v > {low} AND v < {high}][1]"


def _number(value: str, pattern: str) -> str:
    return f"try_cast(replace(regexp_replace(nullif(regexp_extract({value}, '{pattern}', 1), ''), '\\s', '', 'g'), ',', '.') AS DOUBLE)"


SQL = {
    "p23_header_records": f"WITH {_BODY} SELECT * FROM rc",
    "a22_holding_totals": f"WITH {_BODY} SELECT doc_id, sum(estimation_actuelle) AS value, sum(coalesce(capital_restant_du, 0)) AS debt, sum(estimation_actuelle - coalesce(capital_restant_du, 0)) AS net, sum(estimation_actuelle - coalesce(capital_restant_du, 0)) AS net_by_share, count(*) AS properties FROM rc GROUP BY 1",
    "p24_value_columns": """WITH r AS (SELECT l_orderkey AS doc_id, max((l_linenumber % 2 > 0 AND l_partkey % 5 > 0)::INT) AS last, max((l_partkey % 5 > 0)::INT) AS fourth FROM lineitem GROUP BY 1)
      SELECT doc_id, CASE WHEN last = 1 THEN 3 WHEN fourth = 1 THEN 2 ELSE 1 END AS first, CASE WHEN last = 1 THEN 4 WHEN fourth = 1 THEN 3 ELSE 2 END AS second FROM r""",
    "w17_main_tables": """WITH r AS (SELECT l_suppkey AS doc_id, l_linenumber AS t, l_partkey % 6 AS k, l_partkey % 5 > 0 AS num, l_orderkey % 2 = 0 AS x FROM lineitem),
      p AS (SELECT doc_id, t, max((k = 0 AND num)::INT) + max((k = 1 AND num)::INT) + max((k = 2 AND num)::INT) AS hits, sum(num::INT) AS numbers, sum(1 + num::INT + x::INT) AS filled FROM r GROUP BY ALL)
      SELECT doc_id, hits::INT AS hits, numbers::BIGINT AS numbers FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, numbers DESC, filled DESC, t) = 1""",
    "p22_statement_pages": f"WITH {_PAGES} SELECT * FROM st",
    "w16_section_scores": f"WITH {_PAGES}, {_SCORES} SELECT doc_id, section, page, score FROM sc",
    "w16_page_spans": f"""WITH RECURSIVE {_PAGES}, {_SCORES}, o AS (SELECT *, list_position(['bilan_actif', 'bilan_passif', 'compte_resultat'], section) AS k FROM st), n AS (SELECT a.*, (SELECT min(b.page) FROM o b WHERE b.doc_id = a.doc_id AND b.k > a.k) AS next FROM o a),
      w AS (SELECT doc_id, section, page, next, page AS end_page FROM n UNION ALL SELECT w.doc_id, w.section, w.page, w.next, sc.page FROM w JOIN sc ON sc.doc_id = w.doc_id AND sc.section = w.section AND sc.page = w.end_page + 1 AND sc.score >= 2 AND sc.page <= w.page + 3 AND (w.next IS NULL OR sc.page < w.next))
      SELECT doc_id, section, page, max(end_page) AS end_page FROM w GROUP BY ALL""",
    "w15_logical_rows": """WITH i AS (SELECT l_orderkey AS doc_id, l_partkey % 13 AS k, l_suppkey AS s, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS pos FROM lineitem),
      v AS (SELECT *, CASE k WHEN 2 THEN -1000.0 * s WHEN 4 THEN 1000.0 * s WHEN 8 THEN s WHEN 11 THEN 12 END::DOUBLE AS a, CASE k WHEN 2 THEN n WHEN 4 THEN n + 0.5 WHEN 6 THEN s WHEN 8 THEN n WHEN 10 THEN n WHEN 11 THEN 7 END::DOUBLE AS b,
        CASE k WHEN 0 THEN 'Actif immobilisé' WHEN 1 THEN 'Emprunts' WHEN 2 THEN 'dont concours bancaires' WHEN 3 THEN 'du 01/01/2020 au 31/12/2020' WHEN 4 THEN '' WHEN 5 THEN '- à long terme' WHEN 6 THEN 'Dettes fournisseurs:' WHEN 7 THEN 'BRUT' WHEN 8 THEN 'Ligne ' || s || 'x' WHEN 9 THEN 'Terrains' WHEN 10 THEN '- divers' WHEN 11 THEN 'Total' ELSE '12 €' END AS label FROM i),
      h AS (SELECT doc_id, count(a) > 0 AS ha, count(b) > 0 AS hb FROM v GROUP BY 1), y AS (SELECT doc_id, k, pos, label, a, b FROM v UNION ALL SELECT doc_id, -1, 0, 'Poste', 2021, 2020 FROM h),
      r AS (SELECT y.doc_id, pos, k, label, CASE WHEN ha THEN a WHEN hb THEN b END AS n, CASE WHEN hb THEN b ELSE a END AS n1 FROM y JOIN h USING (doc_id)),
      g AS (SELECT *, n IS NOT NULL OR n1 IS NOT NULL AS amount, count(*) FILTER (n IS NOT NULL OR n1 IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM r),
      w AS (SELECT doc_id, grp, list(label ORDER BY pos) FILTER (NOT amount AND k NOT IN (3, 7)) AS waits, max(pos) FILTER (amount) AS pos, max(label) FILTER (amount) AS label, max(n) FILTER (amount) AS n, max(n1) FILTER (amount) AS n1 FROM g GROUP BY ALL),
      t AS (SELECT *, coalesce(len(waits), 0) AS m, [x for x in waits[-3:] if x <> 'Actif immobilisé'] AS named FROM w WHERE pos IS NOT NULL),
      c AS (SELECT *, CASE WHEN m = 0 THEN '' WHEN len(named) = 0 THEN waits[-1] WHEN len(named) >= 2 AND starts_with(named[-1], '-') THEN named[-2] || ' ' || named[-1] ELSE array_to_string(named, ' ') END AS said FROM t),
      f AS (SELECT doc_id, pos AS place, m > 0 AND (label = '' OR label LIKE '-%' OR label LIKE 'dont %') AS rebuilt, CASE WHEN m > 0 AND label = '' THEN said WHEN m > 0 AND (label LIKE '-%' OR label LIKE 'dont %') THEN said || ' ' || label ELSE label END AS label, n, n1 FROM c),
      o AS (SELECT * FROM f WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, label, n, n1 ORDER BY place) = 1)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS pos, label, n, n1, rebuilt FROM o""",
    "a21_lot_totals": """WITH r AS (SELECT l_suppkey AS project_id, 'L' || l_orderkey || '-' || l_linenumber AS lot, l_quantity::BIGINT AS area, floor(l_extendedprice)::BIGINT AS price, l_partkey % 1000 AS deposit FROM lineitem)
      SELECT * FROM r UNION ALL SELECT project_id, 'Total', sum(area)::BIGINT, sum(price)::BIGINT, sum(deposit)::BIGINT FROM r GROUP BY 1""",
    "x1_price_pages": f"""WITH o AS (SELECT o_orderkey, nullif(o_custkey % 120, 0) AS a, CASE o_orderkey % 5 WHEN 0 THEN 'Bien : ' || (3000 + o_custkey) || ' €/m² environ' WHEN 1 THEN 'prix au m2 : 4 ' || (100 + o_custkey % 900) || ' €' WHEN 2 THEN '12 € / m² ; basse 2' || (10 + o_custkey % 90) || ' 000 € moyenne 300 000 € haute : 350 500 €' WHEN 3 THEN 'rien' ELSE 'estimation haute 99 € puis haut de 1' || (100000 + o_custkey) || ' €' END AS page FROM orders),
      f AS (SELECT o_orderkey, a, coalesce({_first('(?i)(\\d[\\d\\s]*)\\s*€\\s*/\\s*m\\s*[²2]', 500, 50000)}, {_first('(?i)prix\\s+au\\s+m[²2]\\s*[:*]*\\s*(\\d[\\d\\s]*)\\s*€', 500, 50000)}) AS m2,
        {', '.join(f"{_first(f'(?i)(?:{w})[^\\d]{{0,30}}(\\d[\\d\\s]{{4,}})\\s*€', 50000, 100000000)} AS {k}" for k, w in (('mid', 'moyenne?|moyen'), ('low', 'basse|bas'), ('high', 'haute?|haut')))} FROM o)
      SELECT o_orderkey, coalesce(m2, floor(mid / a + 0.5)) AS m2, floor(low / a + 0.5) AS low, floor(high / a + 0.5) AS high FROM f""",
    "x2_price_replies": """WITH r AS (SELECT o_orderkey::VARCHAR AS url, unnest(CASE WHEN o_orderkey % 4 = 0 THEN ['mid', 'low'] ELSE ['high'] END) AS kind,
        unnest(CASE WHEN o_orderkey % 4 = 0 THEN [CASE WHEN 1000 + o_custkey < 50000 THEN 1000.0 + o_custkey END, 501.0] ELSE [CASE WHEN 700 + o_custkey < 50000 THEN 700.0 + o_custkey ELSE 800.0 END] END)::DOUBLE AS price FROM orders WHERE o_orderkey % 4 < 2)
      SELECT url, kind, price FROM r WHERE price IS NOT NULL""",
    "x3_price_tables": """WITH o AS (SELECT o_orderkey::VARCHAR AS url, o_custkey AS c, o_orderkey AS k, unnest(['appartement', 'maison']) AS type_bien, unnest([0, 7]) AS add FROM orders)
      SELECT url, type_bien, (2000 + c + add)::DOUBLE AS low, (3100 + c % 800)::DOUBLE AS mid, CASE WHEN k % 3 > 0 THEN 5000.0 END::DOUBLE AS high FROM o WHERE type_bien = 'appartement' OR k % 2 = 0""",
    "x4_land_prices": f"""WITH o AS (SELECT o_orderkey::VARCHAR AS url, 'tourcoing' AS city, CASE o_orderkey % 4 WHEN 0 THEN ['x', 'Prix moyen du terrain constructible en France : ' || (100 + o_custkey) || ',5 €/m²'] WHEN 1 THEN ['TOURCOING (59200)', 'a', '1 ' || (100 + o_custkey % 800) || ' € / m2', 'Calculé sur ' || o_custkey || ' terrains à vendre'] WHEN 2 THEN ['Tourcoing', 'a', 'b', 'c', '99 €/m²'] ELSE ['Lille', '88 €/m²'] END AS lines FROM orders),
      l AS (SELECT url, city, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM o), n AS (SELECT url, pos FROM l WHERE lower(trim(regexp_replace(line, '\\s*\\(\\d{{5}}\\)\\s*$', ''))) = city),
      p AS (SELECT l.url, arg_min({_number('line', _LAND)}, l.pos) AS near FROM l JOIN n ON n.url = l.url AND l.pos BETWEEN n.pos + 1 AND n.pos + 3 WHERE {_number('line', _LAND)} IS NOT NULL GROUP BY 1),
      b AS (SELECT url, array_to_string(lines, chr(10)) AS body FROM o)
      SELECT b.url, coalesce({_number('body', '(?i)Prix\\s+moyen\\s+du\\s+terrain\\s+constructible\\s+(?:en\\s+France|dans\\s+.+?)\\s*:\\s*' + _LAND[4:])}, near) AS price, try_cast(regexp_replace(regexp_extract(body, '(?i)Calculé\\s+sur\\s+(\\d{{1,3}}(?:\\s?\\d{{3}})*)\\s+terrains?\\s+à\\s+vendre', 1), '\\D', '', 'g') AS INT) AS sample FROM b LEFT JOIN p USING (url)""",
}
