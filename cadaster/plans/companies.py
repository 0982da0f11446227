"""Queries on people and companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.operators import companies as c
from cadaster.plans.scalars import _likeness, ascii_words, canonical
from cadaster.plans.scalars import _bare as bare
from cadaster.sources.views import table

# the tables, made from keys alike in both dialects
_PEOPLE = "SELECT c_custkey AS person_id, 'Nom-' || substr('abcdefghij', cast(c_custkey % 10 + 1 AS int), 1) AS nom, CASE c_custkey % 3 WHEN 0 THEN 'Juliette, Lola' WHEN 1 THEN 'Luc' ELSE '' END AS prenoms, CASE c_custkey % 5 WHEN 0 THEN '1970-02-0' || (c_custkey % 7 + 1) WHEN 1 THEN '0' || (c_custkey % 7 + 1) || '/02/1970' WHEN 2 THEN '1970-02' WHEN 3 THEN '03/1970' END AS date_naissance FROM customer"
_FOUND = "SELECT o_custkey AS person_id, o_orderkey AS director_id, 'NOM ' || substr('abcdefghij', cast(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey ELSE o_orderkey END % 10 + 1 AS int), 1) AS nom, CASE o_orderkey % 3 WHEN 0 THEN 'Lola (Juliette)' WHEN 1 THEN 'Luc' ELSE 'Anne' END AS prenom, CASE o_orderkey % 5 WHEN 0 THEN 'Lola' WHEN 1 THEN 'luc' END AS prenom_usuel, 'Nom ' || substr('abc', cast(o_orderkey % 3 + 1 AS int), 1) AS nom_complet, CASE o_orderkey % 4 WHEN 0 THEN '1970-02-0' || (o_orderkey % 7 + 1) WHEN 1 THEN '1970-02' WHEN 2 THEN '05/1981' ELSE '' END AS date_de_naissance, CASE WHEN o_orderkey % 3 > 0 THEN '1970-02' END AS date_de_naissance_rgpd, CASE WHEN o_orderkey % 2 = 0 THEN '2' ELSE '1' END AS s1, ' 2 ' AS s2, o_orderkey AS ordinal FROM orders"
_MANDATES = "SELECT o_custkey AS person_id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE cast(100000000 + cast(floor(o_orderkey / 40) AS int) AS string) END AS siren, 'Stub ' || cast(floor(o_orderkey / 40) AS int) AS nom, o_orderkey AS ordinal, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS role FROM orders"
_DETAILS = "SELECT cast(100000000 + s_suppkey AS string) AS siren, s_name AS nom, CASE s_suppkey % 4 WHEN 0 THEN 'Radié' WHEN 1 THEN '' ELSE 'Actif' END AS statut, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS capital FROM supplier"
_FOLDERS = "SELECT DISTINCT 'p' || cast(floor(o_custkey / 150) AS int) AS project_id, CASE o_orderkey % 4 WHEN 0 THEN 'SCI Lumière ' || (o_custkey % 6) WHEN 1 THEN 'Groupe Nord' WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'F.D. Invest' ELSE 'FD' END ELSE 'Société Est ' || (o_custkey % 4) END AS folder FROM orders"
_POOL = "SELECT 'p' || cast(floor(s_suppkey / 10) AS int) AS project_id, cast(100000000 + s_suppkey AS string) AS siren, CASE s_suppkey % 5 WHEN 0 THEN 'LUMIERE ' || (s_suppkey % 6) WHEN 1 THEN 'FD INVEST SAS' WHEN 2 THEN 'Nord Groupe Holding' WHEN 3 THEN 'Est Conseil' ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'SCI F.D.' ELSE 'LesLumieres' END END AS nom, s_suppkey AS ordinal FROM supplier"
_REPS = "SELECT cast(o_custkey AS string) AS siren, o_orderkey AS ordinal, CASE WHEN o_orderkey % 11 > 0 THEN 'per_' || cast(floor(o_orderkey / 3) AS int) END AS person_id, CASE WHEN o_orderkey % 11 = 0 THEN cast(o_custkey + 2 AS string) END AS company, CASE o_orderkey % 4 WHEN 0 THEN 'Président' WHEN 1 THEN 'Gérant' WHEN 2 THEN 'Directeur' END AS qualite, o_orderkey % 7 = 0 AS entreprise_cessee FROM orders"
_NOTICES = """SELECT doc_id, cast(cast(100000000 + floor(doc_id / 8) AS int) AS string) AS siren, doc_id AS ordinal, '2020-0' || (doc_id % 9 + 1) AS date, CASE doc_id % 9 WHEN 0 THEN 'Avis. Jugement d''ouverture de liquidation judiciaire le ' || doc_id || '. Voir www.x.fr' WHEN 1 THEN 'PLAN DE SAUVEGARDE ARRETE; radiation prononcée'
 WHEN 2 THEN 'Nature jugement : Clôture ' || (doc_id % 4) || '{nl}suite du texte{nl}{nl}Cessation des paiements fixée au 1er mars.' ELSE text END AS contenu FROM documents"""


def _view(spark, sf_dir, sql: str, source: str):
    """A table of this module: a select over one given table."""
    return spark.sql(sql.replace("d''", "d\\'").replace("{nl}", "\\n").replace(f"FROM {source}", "FROM {t}"), t=table(spark, sf_dir, source))


def j5_director_matches(spark, sf_dir):
    return c.match_people(_view(spark, sf_dir, _PEOPLE, "customer"), _directors(spark, sf_dir))


def a20_distinct_directors(spark, sf_dir):
    return c.distinct_directors(_directors(spark, sf_dir), ["person_id"]).select("person_id", "director_id")


def _directors(spark, sf_dir):
    return _view(spark, sf_dir, _FOUND, "orders").withColumn("sirens", F.array("s1", "s2", "s1")).drop("s1", "s2")


def j4_enriched_mandates(spark, sf_dir):
    return c.enrich(_view(spark, sf_dir, _MANDATES, "orders"), _view(spark, sf_dir, _DETAILS, "supplier"))


def a19_merged_companies(spark, sf_dir):
    m = _view(spark, sf_dir, _MANDATES, "orders").join(_view(spark, sf_dir, _DETAILS, "supplier").select("siren", "statut", "capital"), "siren", "left")
    return c.merge_companies(m.drop("person_id"))


def j6_best_company(spark, sf_dir):
    return c.best_matches(_view(spark, sf_dir, _FOLDERS, "orders"), _view(spark, sf_dir, _POOL, "supplier"))


def j7_pool_cascade(spark, sf_dir):
    pool = _view(spark, sf_dir, _POOL, "supplier")
    elsewhere = lambda k: pool.withColumn("project_id", F.expr(f"CASE WHEN ordinal % 3 = {k} THEN project_id ELSE concat('x', project_id) END"))
    return c.cascade(_view(spark, sf_dir, _FOLDERS, "orders"), [elsewhere(0), elsewhere(1), pool])


def _relations(spark, sf_dir):
    """Roots, representatives, mandates and predecessors."""
    reps = _view(spark, sf_dir, _REPS, "orders")
    roots = reps.select("siren").distinct()
    before = roots.select("siren", F.lit(1).alias("ordinal"), F.expr("CASE WHEN siren % 20 = 0 THEN cast(cast(siren AS int) + 2 AS string) ELSE siren END").alias("predecessor"))
    return roots, reps, reps.where("person_id IS NOT NULL"), before


def j18_network_nodes(spark, sf_dir):
    return c.network(*_relations(spark, sf_dir))[0]


def j18_network_edges(spark, sf_dir):
    return c.network(*_relations(spark, sf_dir))[1]


def j19_clean_edges(spark, sf_dir):
    return c.clean_network(*_relations(spark, sf_dir), below=3)


def w14_distress_sentences(spark, sf_dir):
    return c.distress_signal(_view(spark, sf_dir, _NOTICES, "documents"))


def a27_collective_comments(spark, sf_dir):
    return c.collective_comments(_view(spark, sf_dir, _NOTICES, "documents"))


def p19_mandate_display(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS mandate_id", "CASE o_orderkey % 4 WHEN 0 THEN 'Radiée' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Active' END AS statut", "CASE o_orderkey % 3 WHEN 0 THEN 'Inscrit' WHEN 1 THEN 'RADIÉ du RCS' END AS statut_rcs",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'Gérant' END AS role", "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1000.5D END AS capital", "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey * 10.0D END AS ca", "cast(NULL AS double) AS rn")
    return c.mandate_display(rows)


def a14_mandate_counts(spark, sf_dir):
    return c.mandate_counts(_in_folders(spark, sf_dir))


def _in_folders(spark, sf_dir):
    return _view(spark, sf_dir, _MANDATES, "orders").withColumn("folder", F.concat(F.lit("d"), F.floor(F.col("person_id") / 5)))


def a14_person_cards(spark, sf_dir):
    text_of = F.array_join(F.transform("companies", lambda x: F.concat_ws(" ", x["siren"], x["nom"])), "; ")
    return c.person_cards(_in_folders(spark, sf_dir)).select("folder", "person_id", "value", text_of.alias("companies"))


def a27_merged_comments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 > 0 THEN concat(' Radiée  le ', o_custkey % 7) END AS a", "CASE o_orderkey % 3 WHEN 0 THEN concat('RADIÉE LE ', o_custkey % 5) WHEN 1 THEN '   ' END AS b", "CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority END AS c")
    return rows.select("o_orderkey", c.merged_comments(F.col("a"), F.col("b"), F.col("c")).alias("comment"))


def a16_catalogue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    people = o.selectExpr("concat('p', cast(floor(o_custkey / 10) AS int)) AS project_id", "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Hélène ' ELSE 'helene ' END, 'N', o_custkey % 40) AS name", "o_orderkey AS ordinal")
    firms = o.selectExpr("concat('p', cast(floor(o_custkey / 10) AS int)) AS project_id", "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'SCI ' ELSE 'sci-' END, o_custkey % 30, 'x') AS name", "o_orderkey AS ordinal", "CASE WHEN o_orderkey % 4 = 0 THEN 'cache' ELSE 'extraction' END AS source")
    return c.catalogue(people, firms)


QUERIES = {f.__name__: f for f in (j5_director_matches, a20_distinct_directors, j4_enriched_mandates, a19_merged_companies, j6_best_company, j7_pool_cascade, j18_network_nodes, j18_network_edges, j19_clean_edges, w14_distress_sentences, a27_collective_comments, p19_mandate_display, a14_mandate_counts, a14_person_cards, a27_merged_comments, a16_catalogue)}


def _duck(sql: str) -> str:
    return sql.replace("AS string", "AS VARCHAR").replace("{nl}", "' || chr(10) || '")


def _letters(x: str) -> str:
    return f"regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z]', '', 'g')"


def _iso(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim({x}), '^(\\d{{2}})/(\\d{{2}})/(\\d{{4}})$', '\\3-\\2-\\1'), '^(\\d{{2}})/(\\d{{4}})$', '\\2-\\1')"


def _similar(x: str, y: str) -> str:
    return f"greatest({_likeness(x, y)}, {_likeness(bare(x), bare(y))})"


def _best(pool: str) -> str:
    return f"""SELECT project_id, folder, siren, nom, score FROM (SELECT DISTINCT f.project_id, folder, siren, nom, ordinal, greatest({_similar('folder', 'nom')}, {_similar('nom', 'folder')}) AS score
      FROM fo f JOIN {pool} p ON f.project_id = p.project_id) WHERE score > 0.35
      QUALIFY row_number() OVER (PARTITION BY project_id, folder ORDER BY score DESC, ordinal) = 1"""


_NET = f"""
rp AS ({_duck(_REPS)}), pe AS (SELECT siren, ordinal, person_id, coalesce(qualite, 'Dirigeant') AS qualite, entreprise_cessee FROM rp WHERE person_id IS NOT NULL), ro AS (SELECT DISTINCT siren AS root FROM rp),
vi AS (SELECT siren AS root, company AS siren, 1 AS rank, 'soc_' || siren AS src, coalesce(qualite, 'Lié') AS label, false AS dashed, ordinal AS o1, 0 AS o2 FROM rp WHERE company IS NOT NULL
  UNION ALL SELECT a.siren, m.siren, 2, m.person_id, m.qualite, false, a.ordinal, m.ordinal FROM pe a JOIN pe m ON a.person_id = m.person_id AND NOT m.entreprise_cessee
  UNION ALL SELECT root, (root::INT + 2)::VARCHAR, 1, 'soc_' || root, 'Prédécesseur', true, 1000000000000, 1 FROM ro WHERE root::INT % 20 = 0),
lk AS (SELECT * FROM vi WHERE siren <> root QUALIFY row_number() OVER (PARTITION BY root, siren ORDER BY o1, o2, src) = 1),
al AS (SELECT root, root AS siren, 0 AS rank, NULL AS src, NULL AS label, false AS dashed, -1 AS o1, -1 AS o2 FROM ro UNION ALL SELECT * FROM lk),
nd AS (SELECT root, node, rank FROM (SELECT root, 'soc_' || siren AS node, rank, o1, o2 FROM al UNION ALL SELECT root, person_id, rank + 1, o1, o2 FROM al JOIN pe USING (siren)) QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY o1, o2) = 1),
ed AS (SELECT root, src, 'soc_' || siren AS dst, label, dashed FROM lk UNION SELECT root, 'soc_' || siren, person_id, qualite, false FROM al JOIN pe USING (siren))"""
_FIRSTS = f"""
f0 AS ({_duck(_FOUND)}), f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY person_id, nom_complet, coalesce(nullif(date_de_naissance, ''), date_de_naissance_rgpd, ''), s1 = '2' ORDER BY ordinal) = 1)"""
_KEYS = "[" + ", ".join("'" + k.replace("'", "''") + "'" for k in c.DISTRESS) + "]"

SQL = {
    "a20_distinct_directors": f"WITH {_FIRSTS} SELECT person_id, director_id FROM f",
    "j5_director_matches": f"""WITH p AS ({_duck(_PEOPLE)}), {_FIRSTS},
      r AS (SELECT person_id, director_id, {_letters('p.nom')} <> '' AND {_letters('f.nom')} = {_letters('p.nom')} AND ({_letters("string_split(prenoms, ',')[1]")} = '' OR list_contains([{_letters('x')} for x in flatten([[prenom, prenom_usuel, nom_complet], regexp_split_to_array(prenom, '[\\s,;/()-]+'), regexp_split_to_array(nom_complet, '[\\s,;/()-]+')])], {_letters("string_split(prenoms, ',')[1]")})) AS named,
        {_iso('date_naissance')} AS pb, {_iso('date_de_naissance')} AS db, date_de_naissance_rgpd AS mb FROM f JOIN p USING (person_id)),
      n AS (SELECT *, length(pb) = 10 AND coalesce(pb = db, false) AS exact, coalesce(pb[1:7] = coalesce(nullif(db[1:7], ''), mb), false) AS month FROM (SELECT *, max(named::INT) OVER (PARTITION BY person_id) AS any_named FROM r) WHERE any_named = 0 OR named),
      w AS (SELECT *, count(*) OVER v AS n, count(*) FILTER (exact) OVER v AS ex, count(*) FILTER (month) OVER v AS mo FROM n WINDOW v AS (PARTITION BY person_id)),
      m AS (SELECT person_id, director_id, CASE WHEN ex > 0 THEN CASE WHEN exact OR month THEN 'date_de_naissance_plus_rgpd' END WHEN mo > 0 THEN CASE WHEN month THEN 'date_de_naissance_rgpd' END WHEN n = 1 THEN 'candidat_unique' END AS mode FROM w)
      SELECT * FROM m WHERE mode IS NOT NULL""",
    "j4_enriched_mandates": f"WITH m AS ({_duck(_MANDATES)}), d AS ({_duck(_DETAILS)}) SELECT person_id, m.siren, coalesce(d.nom, m.nom) AS nom_societe, statut, capital FROM m LEFT JOIN d ON length(m.siren) = 9 AND d.siren = m.siren",
    "a19_merged_companies": f"""WITH m AS ({_duck(_MANDATES)}), d AS ({_duck(_DETAILS)}), j AS (SELECT m.*, statut, capital FROM m LEFT JOIN d USING (siren))
      SELECT coalesce(nullif(siren, ''), lower(nom)) AS key, arg_min(siren, ordinal) FILTER (siren <> '') AS siren, arg_min(nom, ordinal) AS nom, arg_min(statut, ordinal) FILTER (statut <> '') AS statut, arg_min(capital, ordinal) FILTER (capital IS NOT NULL) AS capital, arg_min(role, ordinal) FILTER (role <> '') AS role, min(ordinal) AS ordinal FROM j GROUP BY 1""",
    "j6_best_company": f"WITH fo AS ({_duck(_FOLDERS)}), po AS ({_duck(_POOL)}) SELECT *, score >= 0.55 AS confident FROM ({_best('po')})",
    "j7_pool_cascade": f"""WITH fo AS ({_duck(_FOLDERS)}), p2 AS ({_duck(_POOL)}), p0 AS (SELECT * FROM p2 WHERE ordinal % 3 = 0), p1 AS (SELECT * FROM p2 WHERE ordinal % 3 = 1),
      u AS (SELECT *, 0 AS match_tier FROM ({_best('p0')}) UNION ALL SELECT *, 1 FROM ({_best('p1')}) UNION ALL SELECT *, 2 FROM ({_best('p2')})) SELECT project_id, folder, siren, score, match_tier FROM u QUALIFY row_number() OVER (PARTITION BY project_id, folder ORDER BY match_tier) = 1""",
    "j18_network_nodes": f"WITH {_NET} SELECT * FROM nd",
    "j18_network_edges": f"WITH {_NET} SELECT * FROM ed",
    "j19_clean_edges": f"WITH {_NET}, k AS (SELECT root, node FROM nd WHERE rank < 3) SELECT root, src, dst, min(label) AS label FROM ed WHERE (root, src) IN (SELECT root, node FROM k) AND (root, dst) IN (SELECT root, node FROM k) GROUP BY ALL",
    "w14_distress_sentences": f"""WITH p AS ({_duck(_NOTICES)}), k AS (SELECT unnest(range({len(c.DISTRESS)})) AS i, unnest([trim({ascii_words('x')}) for x in {_KEYS}]) AS k),
      s AS (SELECT siren, ordinal, unnest(x) AS raw, unnest(range(len(x))) AS pos FROM (SELECT siren, ordinal, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(contenu), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\s*\\n+\\s*', chr(10), 'g'), '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS x FROM p)),
      t AS (SELECT siren, ordinal, pos, trim(raw) AS sentence, trim({ascii_words('raw')}) AS plain FROM s),
      h AS (SELECT siren, ordinal, pos, sentence, count(*) AS hits, min(i) AS worst FROM t JOIN k ON contains(plain, k) GROUP BY ALL),
      z AS (SELECT *, length(sentence) AS n, length(regexp_replace(sentence, '\\P{{Lu}}', '', 'g')) / nullif(length(regexp_replace(sentence, '\\P{{L}}', '', 'g')), 0) > 0.55 AS caps FROM h)
      SELECT siren, sentence, matched FROM (SELECT *, (SELECT count(DISTINCT ordinal) FROM h WHERE h.siren = z.siren) AS matched FROM z
        QUALIFY row_number() OVER (PARTITION BY siren ORDER BY hits DESC, worst, regexp_matches(sentence, '[.!?]$') DESC, abs(n - 160) + CASE WHEN n < 40 THEN 60 ELSE 0 END + greatest(n - 320, 0), regexp_matches(lower(sentence), 'https?://|www\\.'), coalesce(caps, false), n, ordinal, pos) = 1)""",
    "a27_collective_comments": f"""WITH p AS ({_duck(_NOTICES)}), n AS (SELECT siren, date, ordinal, nullif(trim(regexp_extract(contenu, '(?m)^\\s*Nature jugement\\s*:\\s*(.+?)\\s*$', 1)), '') AS nature FROM p),
      l AS (SELECT siren, date || ' - ' || nature AS line, min(struct_pack(d := date, o := ordinal)) AS first FROM n WHERE nature IS NOT NULL GROUP BY ALL) SELECT siren, string_agg(line, chr(10) ORDER BY first) AS comment FROM l GROUP BY 1""",
    "p19_mandate_display": """WITH r AS (SELECT o_orderkey AS mandate_id, CASE o_orderkey % 4 WHEN 0 THEN 'Radiée' WHEN 3 THEN 'Active' END AS s, CASE o_orderkey % 3 WHEN 0 THEN 'Inscrit' WHEN 1 THEN 'RADIÉ du RCS' END AS rcs, CASE WHEN o_orderkey % 5 = 0 THEN 'Gérant' END AS role,
        CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 1000.5 END::DOUBLE AS capital, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey * 10.0 END::DOUBLE AS ca FROM orders)
      SELECT mandate_id, nullif(concat_ws(' | ', s, 'RCS: ' || rcs), '') AS statut, coalesce(s LIKE 'Radi%', false) OR coalesce(rcs LIKE 'RADI%', false) AS radie, coalesce(role, CASE WHEN rcs LIKE 'RADI%' THEN 'X' END) AS role,
        nullif(concat_ws(' | ', 'Capital: ' || replace(regexp_replace(format('{:,.2f}', capital), '\\.?0+$', ''), ',', ' '), 'CA: ' || replace(regexp_replace(format('{:,.2f}', ca), '\\.?0+$', ''), ',', ' ')), '') AS infos FROM r""",
    "a14_mandate_counts": f"WITH m AS ({_duck(_MANDATES)}) SELECT 'd' || (person_id // 5) AS folder, count(DISTINCT person_id) AS people, count(DISTINCT siren) AS companies, count(*) AS mandates FROM m GROUP BY 1",
    "a14_person_cards": f"""WITH m AS ({_duck(_MANDATES)}) SELECT 'd' || (person_id // 5) AS folder, person_id, count(*) || ' société(s) trouvée(s)' AS value, string_agg(siren || ' ' || nom, '; ' ORDER BY ordinal) AS companies FROM m GROUP BY ALL""",
    "a27_merged_comments": """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN 'Radiée le ' || (o_custkey % 7) END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'RADIÉE LE ' || (o_custkey % 5) END AS b, CASE WHEN o_orderkey % 5 > 2 THEN o_orderpriority END AS c FROM orders)
      SELECT o_orderkey, nullif(concat_ws(chr(10), a, CASE WHEN coalesce(lower(a), '') <> lower(b) THEN b END, c), '') AS comment FROM r""",
    "a16_catalogue": f"""WITH p AS (SELECT 'p' || (o_custkey // 10) AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Hélène ' ELSE 'helene ' END || 'N' || (o_custkey % 40) AS name, o_orderkey AS k FROM orders),
      c AS (SELECT 'p' || (o_custkey // 10) AS project_id, CASE WHEN o_orderkey % 3 = 0 THEN 'SCI ' ELSE 'sci-' END || (o_custkey % 30) || 'x' AS name, CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE 1000000000 + o_orderkey END AS k FROM orders)
      SELECT project_id, {canonical('name')} AS key, arg_max(name, k) AS name, 'person' AS kind FROM p GROUP BY ALL UNION ALL SELECT project_id, {canonical('name')}, arg_min(name, k), 'company' FROM c GROUP BY ALL""",
}
