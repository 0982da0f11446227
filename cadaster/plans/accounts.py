"""Queries on annual accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.functions import numbers
from cadaster.operators import accounts as a
from cadaster.plans.scalars import canonical
from cadaster.sources.views import files, table

# labels of raw lines, by table: equal ones, ones that contain a known label, sections, unknown ones
_POSTES = {
    "actif": ["Immobilisations corporelles", "Terrains", "Constructions", "Stocks", "Total créances clients nettes", "Autres créances", "Disponibilités", "Actif circulant", "Total actif", "Divers inconnu", "Fonds commercial", "1. Marchandises", "Total des stocks", "Trésorerie nette", "VMP", "Frais d'établissement", "Frais de recherche et développement", "Immobilisations corporelles en cours", "Autres créances diverses", "Taxe sur la valeur ajoutée", "Total général"],
    "passif": ["Capital social", "Réserves", "Capitaux propres", "Dettes fournisseurs", "Emprunts auprès des établissements de crédit", "Dettes fiscales et sociales", "Total passif", "Dettes", "Zzz", "Autres dettes à court terme", "Résultat de l'exercice", "Provisions pour charges", "Comptes courants d'associés", "Ecarts de réévaluation", "Total dettes d'exploitation", "Dettes sur immobilisations"],
    "compte_resultat": ["Chiffre d'affaires net", "Ventes de marchandises", "Charges d'exploitation", "Salaires et traitements", "Charges sociales", "Résultat d'exploitation", "Résultat financier", "Résultat courant avant impôts", "Résultat exceptionnel", "Impôts sur les bénéfices", "Résultat net", "Achats de marchandises (détail)", "Autre", "Production stockée", "Subventions d'exploitation", "Reprises sur amortissements et provisions", "Autres produits", "Autres charges d'exploitation", "Total des charges", "Reprise sur amortissements et provisions, transferts de charges", "Variation de stock marchandises", "Dotations amortissements", "Participation des salariés aux résultats", "Opérations en commun", "Achats de matièspremières et autres approvisionnements"],
}


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _spark_list(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _pick(quote, get) -> str:
    """The label of a line, by its table and key."""
    return "CASE o_orderkey % 3 " + " ".join(f"{w} {get(quote(v), f'cast((o_orderkey // 3) % {len(v)} + 1 AS int)')}" for w, v in zip(("WHEN 0 THEN", "WHEN 1 THEN", "ELSE"), _POSTES.values(), strict=True)) + " END"


_SPARK_POSTE = _pick(_spark_list, lambda v, i: f"element_at({v}, {i})").replace("//", "div")
_DUCK_POSTE = _pick(_sql_list, lambda v, i: f"{v}[{i}]")
_COMPANY = "cast(floor(o_custkey / 10) AS int)"  # ten customers a company: as many companies as the tables ask for
_LINE = """'c' || cast(floor(o_custkey / 10) AS int) AS company, CASE o_orderkey % 3 WHEN 0 THEN 'actif' WHEN 1 THEN 'passif' ELSE 'compte_resultat' END AS table_type, cast(o_orderkey AS int) AS idx, {poste} AS poste,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 997 = 0 THEN 3e9 ELSE cast(floor(o_totalprice) AS double) END AS n, CASE WHEN o_orderkey % 7 > 0 THEN cast(floor(o_totalprice * 9 / 10) AS double) END AS n1,
  CASE WHEN o_orderkey % 4 = 0 THEN {poste} WHEN o_orderkey % 4 = 1 THEN '' END AS given_key"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*_split(_LINE.format(poste=_SPARK_POSTE)))


def _split(columns: str) -> list[str]:
    """The columns of a select list: cut at commas outside brackets and quotes."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(columns):
        ch = columns[i]
        if ch == "\\":
            i += 1
        elif ch == "'":
            quoted = not quoted
        elif not quoted:
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 0:
                out.append(columns[start:i])
                start = i + 1
        i += 1
    return [*out, columns[start:]]


def _canonical(spark, sf_dir):
    return a.canonical_lines(a.map_labels(lines(spark, sf_dir), a.dictionary(spark)))


def j3_label_mapping(spark, sf_dir):
    return a.map_labels(lines(spark, sf_dir), a.dictionary(spark)).groupBy("table_type", "poste", "key", "is_total").agg(F.count("*").alias("lines"))


def a6_canonical_lines(spark, sf_dir):
    return _canonical(spark, sf_dir)


def a7_keyed_rows(spark, sf_dir):
    return a.keyed_rows(lines(spark, sf_dir), a.dictionary(spark))


_TOLD = "SELECT 'c' || cast(floor(o_custkey / 10) AS int) AS company, 'bilan_' || CASE o_orderkey % 4 WHEN 0 THEN 'stocks' WHEN 1 THEN 'capital_social' WHEN 2 THEN 'dettes_diverses' ELSE 'inconnu' END || CASE WHEN o_orderkey % 3 > 0 THEN '_n' ELSE '_n1' END AS field_id, CASE WHEN o_orderkey % 5 > 0 THEN '1 ' || (100 + o_orderkey % 900) END AS value FROM orders"


def a8_metrics(spark, sf_dir):
    return a.metrics(_canonical(spark, sf_dir), spark.sql(_TOLD.replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders")))


def a9_validation(spark, sf_dir):
    return a.checks(_canonical(spark, sf_dir)).withColumn("gap", F.round("gap", 9))


def a10_quality(spark, sf_dir):
    found = _canonical(spark, sf_dir)
    return a.quality(found, a.checks(found))


_ANSWERS = "SELECT o_custkey AS company, CASE o_orderkey % 5 WHEN 0 THEN 'bilan_actif_table' WHEN 1 THEN 'bilan_societe_nom' WHEN 2 THEN 'bilan_date_arrete_n' WHEN 3 THEN 'nom' ELSE 'adresse' END AS field, o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE concat('v', o_orderkey) END AS value FROM orders"


def j20_better_answers(spark, sf_dir):
    e = spark.sql(_ANSWERS.replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders"))
    answers = lambda pick: e.groupBy("company", "field").agg(pick("value", "o_orderkey").alias("value"))
    scores = e.groupBy("company").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("first_score"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("second_score"))
    return a.better(answers(F.max_by), answers(F.min_by), scores)


def _statement(spark, sf_dir, table_type=None):
    rows = _canonical(spark, sf_dir)
    return rows.where(F.col("table_type") == table_type) if table_type else rows


def _rounded(report):
    return report.withColumns({c: F.round(c, 9) for c in ("n", "n1")})


def a23_balance_report(spark, sf_dir):
    told = spark.sql(_TOLD.replace("FROM orders", "FROM {t}"), t=table(spark, sf_dir, "orders"))
    return a.balance_report(a.metrics(_canonical(spark, sf_dir).where("table_type <> 'compte_resultat'"), told))


def a24_result_report(spark, sf_dir):
    return _rounded(a.result_report(a.metrics(_statement(spark, sf_dir, "compte_resultat"))))


def _two_sources(spark, sf_dir):
    """Statement lines as a document and as the registry give them."""
    rows = table(spark, sf_dir, "orders").selectExpr(f"{_COMPANY} AS company", "CASE o_orderkey % 2 WHEN 0 THEN 'compte_resultat' ELSE 'actif' END AS section", f"element_at({_spark_list(a.ORDER)}, cast(o_orderkey % 10 + 1 AS int)) AS label", "o_orderkey", "floor(o_totalprice) AS v")
    one = lambda shared, name: rows.withColumn("label", F.expr(f"CASE WHEN {shared} THEN label ELSE concat('{name} ', label) END")).groupBy("company", "section", "label").agg(F.min("o_orderkey").alias("ordinal"), F.max_by("v", "o_orderkey").cast("double").alias("n"), F.min_by("v", "o_orderkey").cast("double").alias("n1"))
    # the registry has some labels twice
    again = one("o_orderkey % 5 < 3", "Registre")
    twice = again.where("ordinal % 4 = 0").selectExpr("company", "section", "label", "ordinal + 1000000000 AS ordinal", "n + 1 AS n", "n1")
    return one("o_orderkey % 5 > 1", "Document"), again.unionByName(twice)


def j9_four_columns(spark, sf_dir):
    return a.four_columns(*_two_sources(spark, sf_dir))


def a25_margins(spark, sf_dir):
    rows = a.four_columns(*_two_sources(spark, sf_dir)).where("section = 'compte_resultat'")
    return a.with_margins(rows).select("company", "label", "place", *(F.round(c, 9).alias(c) for c in ("document_n", "document_n1", "registry_n", "registry_n1")))


def o2_statement_order(spark, sf_dir):
    rows = lines(spark, sf_dir).where("table_type = 'compte_resultat'")
    return rows.select("company", "idx", "poste", a.statement_rank(F.col("poste")).alias("rank"), F.expr("row_number() OVER (PARTITION BY company ORDER BY idx)").alias("input_place"))


def j8_group_values(spark, sf_dir):
    given = table(spark, sf_dir, "orders").selectExpr(f"{_COMPANY} AS company", "o_orderkey AS ordinal", "CASE WHEN o_orderkey % 3 > 0 THEN concat('B', o_orderkey % 12) ELSE '' END AS code", f"element_at({_spark_list(a.ORDER)}, cast(o_orderkey % 10 + 1 AS int)) AS label", "floor(o_totalprice) AS n", "CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) END AS n1")
    groups = spark.createDataFrame([("Exploitation", ["B1", "resultat d'exploitation"]), ("Personnel", ["B5", "B7"]), ("Rien", ["ZZ"])], "label string, sources array<string>")
    return a.group_values(given, groups)


def j15_registry_year(spark, sf_dir):
    documents = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", f"{_COMPANY} AS company", "CASE WHEN o_orderkey % 4 > 0 THEN cast(2010 + o_orderkey % 15 AS int) END AS year")
    filings = table(spark, sf_dir, "orders").selectExpr(f"{_COMPANY} AS company", "cast(2008 + o_orderkey % 13 AS int) AS year")
    return a.pick_year(documents, filings)


def _filings(spark, sf_dir):
    """Registry payloads: for each supplier one year of a balance sheet and a result section, as JSON."""
    column = lambda name, value: f"named_struct('libelle', '{name}', 'valeur', {value})"
    line = lambda code, label, cols: f"named_struct('code', {code}, 'libelle', '{label}', 'colonnes', array({', '.join(cols)}))"
    v = "cast(floor(s_acctbal) AS double)"
    first = line("CASE WHEN s_suppkey % 2 = 0 THEN '028' ELSE '142' END", "Ligne A", [column("Net année N", "cast(NULL AS double)"), column("Total année N", v), column("Montant année N-1", v)])
    second = line("'ZZ'", "Ligne B", [column("Montant année N", v), column("Montant brut", f"{v} + 1")])
    section = lambda name, *ls: f"named_struct('libelle', {name}, 'liasses', array({', '.join(ls)}))"
    sections = f"array({section("CASE s_suppkey % 3 WHEN 0 THEN 'Bilan' WHEN 1 THEN 'Bilan Actif' ELSE 'Passif' END", first, second)}, {section("'Compte de résultat'", second)})"
    nested = f"to_json(map(cast(2015 + s_suppkey % 8 AS string), array(named_struct('date_cloture', '31-12', 'sections', {sections}))))"
    flat = f"to_json(named_struct('entries', array(named_struct('y', cast(2015 + s_suppkey % 8 AS string), 'lines', array(named_struct('side', 'actif', 'code', '010', 'label', 'Ligne plate', 'n', {v}))))))"
    return table(spark, sf_dir, "supplier").selectExpr("cast(100000000 + s_suppkey AS string) AS siren", f"CASE WHEN s_suppkey % 5 > 0 THEN {nested} ELSE {flat} END AS payload")


def a26_src6_p20_p21_filings(spark, sf_dir):
    return a.flatten_filings(_filings(spark, sf_dir)).drop("entry")


def a26_filing_totals(spark, sf_dir):
    return a.flatten_filings(_filings(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("lines"), F.array_join(F.sort_array(F.collect_set("year")), ",").alias("years"), F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def _company_files(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("company_folder", F.concat_ws("/", "project_id", F.expr("concat('S', doc_id % 9)")))
    return rows.withColumn("year", F.when(F.col("doc_id") % 3 > 0, numbers.latest_year(F.regexp_replace("filename", r"\.\w+$", ""), F.col("filename"))))


def w13_latest_documents(spark, sf_dir):
    return a.latest_documents(_company_files(spark, sf_dir)).select("company_folder", "source_path", "year")


def a13_latest_year_filter(spark, sf_dir):
    return a.of_latest_year(_company_files(spark, sf_dir)).groupBy("company_folder", "last").agg(F.count("*").alias("kept"))


def a18_company_periods(spark, sf_dir):
    rows = a.company_periods(_company_files(spark, sf_dir))
    return rows.select("company_folder", "place", "period", F.size("files").alias("n"), F.array_join(F.transform("files", lambda f: f["name"]), "; ").alias("files"))


QUERIES = {f.__name__: f for f in (
    j3_label_mapping, a6_canonical_lines, a7_keyed_rows, a8_metrics, a9_validation, a10_quality, j20_better_answers, a23_balance_report, a24_result_report, j9_four_columns, a25_margins, o2_statement_order,
    j8_group_values, j15_registry_year, a26_src6_p20_p21_filings, a26_filing_totals, w13_latest_documents, a13_latest_year_filter, a18_company_periods,
)}

# --- the same in DuckDB ---------------------------------------------------------------------------


def _value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


_WORDS = "words(table_type, rank, label_key, key, is_total) AS (VALUES " + ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in a.entries()) + ")"
_LINES = f"ln AS (SELECT {_LINE.format(poste=_DUCK_POSTE)} FROM orders)"


def _key(x: str) -> str:
    return f"replace({canonical(f"translate({x}, '''’', '  ')")}, ' ', '')"


def _mapped(source: str, poste: str = "poste") -> str:
    return f"""
lb AS (SELECT DISTINCT table_type, {poste} AS poste, {_key(poste)} AS label_key FROM {source}),
ex AS (SELECT lb.table_type, lb.poste, lb.label_key, w.rank, w.key, w.is_total FROM lb LEFT JOIN words w USING (table_type, label_key)),
nr AS (SELECT ex.table_type, ex.poste, w.key, w.is_total FROM ex JOIN words w ON w.table_type = ex.table_type AND w.key IS NOT NULL AND length(w.label_key) >= 6 AND contains(ex.label_key, w.label_key) WHERE ex.rank IS NULL
  QUALIFY row_number() OVER (PARTITION BY ex.table_type, ex.poste ORDER BY length(w.label_key) DESC, w.rank) = 1),
kn AS (SELECT ex.table_type, ex.poste, CASE WHEN ex.rank IS NOT NULL THEN ex.key ELSE nr.key END AS key, CASE WHEN ex.rank IS NOT NULL THEN ex.is_total ELSE nr.is_total END AS is_total FROM ex LEFT JOIN nr USING (table_type, poste))"""


_CANON = f"""{_WORDS}, {_LINES}, {_mapped('ln')},
mp AS (SELECT ln.*, kn.key, kn.is_total FROM ln JOIN kn USING (table_type, poste)),
gr AS (SELECT company, table_type, key, min(idx) AS idx, count(*) FILTER (is_total) AS totals, arg_max(poste, idx) FILTER (is_total) AS t_poste, arg_max_null(n, idx) FILTER (is_total) AS t_n, arg_max_null(n1, idx) FILTER (is_total) AS t_n1,
  sum(n) FILTER (NOT is_total) AS s_n, sum(n1) FILTER (NOT is_total) AS s_n1, string_agg(poste, ' + ' ORDER BY idx) FILTER (NOT is_total) AS names FROM mp WHERE key IS NOT NULL GROUP BY ALL),
c1 AS (SELECT company, table_type, key, idx, CASE WHEN totals > 0 THEN t_poste ELSE names END AS poste, CASE WHEN totals > 0 THEN t_n ELSE s_n END AS n, CASE WHEN totals > 0 THEN t_n1 ELSE s_n1 END AS n1 FROM gr),
ca AS (SELECT company, table_type, CASE WHEN key = 'capitaux_propres_detail' THEN 'capitaux_propres' ELSE key END AS key, idx, poste, n, n1 FROM c1 WHERE key <> 'capitaux_propres_detail' OR NOT EXISTS (SELECT 1 FROM c1 d WHERE d.company = c1.company AND d.table_type = c1.table_type AND d.key = 'capitaux_propres')
  UNION ALL SELECT company, table_type, 'raw_unmatched_' || table_type || '_' || CASE WHEN idx < 100 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END, idx, poste, n, n1 FROM mp WHERE key IS NULL AND coalesce(n, n1) IS NOT NULL)"""
_PARTS = "parts(metric, key, sign, needed) AS (VALUES " + ", ".join(f"('{m}', '{k.lstrip('-')}', {-1 if k.startswith('-') else 1}, {len(ks)})" for m, ks in a.COMPONENTS.items() for k in ks) + ")"


def _metrics(source: str = "ca") -> str:
    return f"""{_PARTS},
sm AS (SELECT company, metric, needed, sum(sign * n) AS n_s, count(n) AS n_c, sum(sign * n1) AS n1_s, count(n1) AS n1_c FROM {source} JOIN parts USING (key) GROUP BY ALL),
ow AS (SELECT company, key AS metric, arg_min_null(n, idx) AS n, arg_min_null(n1, idx) AS n1 FROM {source} GROUP BY ALL),
me AS (SELECT company, metric, CASE WHEN n_c = needed THEN n_s ELSE coalesce(n, n_s) END AS n, CASE WHEN n1_c = needed THEN n1_s ELSE coalesce(n1, n1_s) END AS n1 FROM ow FULL JOIN sm USING (company, metric))"""


_SUM = lambda keys: "CASE WHEN coalesce(" + ", ".join(keys) + ") IS NOT NULL THEN " + " + ".join(f"coalesce({k}, 0)" for k in keys) + " END"
# the lists of the survey's source, not the library's
_ASSETS = "immobilisations_corporelles immobilisations_financieres stocks creances_clients autres_creances disponibilites vmp charges_constatees_avance autres_actif_residuel".split()
_LIABILITIES = "capitaux_propres dettes_bancaires autres_dettes_financieres fournisseurs dettes_fiscales_sociales dettes_diverses provisions_pour_risques provisions_pour_charges produits_constates_avance autres_passif_residuel".split()
_EXPENSES = "achats_marchandises variation_stock_marchandises achats_matieres_premieres variation_stock_matieres_premieres autres_charges_externes salaires charges_sociales impots_taxes dotations_amortissements dotations_provisions autres_charges_exploitation".split()
_WANTED = sorted({*_ASSETS, *_LIABILITIES, *_EXPENSES, *a.CRITICAL, "resultat_financier", "operations_en_commun", "resultat_exceptionnel", "impots_sur_les_societes", "participation_salaries"})
_CHECKS = f"""
lg AS (SELECT company, key, 'n' AS period, n AS v FROM ca UNION ALL SELECT company, key, 'n1', n1 FROM ca),
wd AS (SELECT company, period, {', '.join(f"max(v) FILTER (key = '{k}') AS {k}" for k in _WANTED)} FROM lg GROUP BY ALL),
w2 AS (SELECT *, {_SUM(_ASSETS)} AS sa, {_SUM(_LIABILITIES)} AS sl, {_SUM(_EXPENSES)} AS se FROM wd),
ck AS (SELECT company, period, 'actif' AS "check", sa AS lhs, total_actif AS rhs, CASE WHEN sa > 0 AND total_actif <> 0 THEN abs(sa - total_actif) / abs(total_actif) END AS gap FROM w2
  UNION ALL SELECT company, period, 'passif', sl, total_passif, CASE WHEN sl > 0 AND total_passif <> 0 THEN abs(sl - total_passif) / abs(total_passif) END FROM w2
  UNION ALL SELECT company, period, 'exploitation', chiffre_affaires - se, resultat_exploitation, CASE WHEN se > 0 AND abs(resultat_exploitation) > 0 AND abs(chiffre_affaires - charges - resultat_exploitation) / greatest(abs(resultat_exploitation), 1) > 0.05 THEN abs(chiffre_affaires - se - resultat_exploitation) / greatest(abs(resultat_exploitation), 1) END FROM w2
  UNION ALL SELECT company, period, 'charges', se, charges, CASE WHEN charges > 0 AND se > 0 THEN abs(se - charges) / abs(charges) END FROM w2
  UNION ALL SELECT company, period, 'courant', resultat_exploitation + resultat_financier + coalesce(operations_en_commun, 0), resultat_courant_avant_impots, abs(resultat_exploitation + resultat_financier + coalesce(operations_en_commun, 0) - resultat_courant_avant_impots) / CASE WHEN resultat_courant_avant_impots IS NOT NULL THEN greatest(abs(resultat_courant_avant_impots), 1) END FROM w2
  UNION ALL SELECT company, period, 'net', resultat_courant_avant_impots + resultat_exceptionnel - impots_sur_les_societes - coalesce(participation_salaries, 0), resultat_net, abs(resultat_courant_avant_impots + resultat_exceptionnel - impots_sur_les_societes - coalesce(participation_salaries, 0) - resultat_net) / greatest(abs(resultat_net), 1) FROM w2
  UNION ALL SELECT company, period, 'croise', total_actif, total_passif, abs(total_actif - total_passif) / greatest(abs(total_actif), abs(total_passif), 1) FROM w2),
fl AS (SELECT * FROM ck WHERE gap > 0.05)"""


def _wide(source: str, names: list[str]) -> str:
    return f"w AS (SELECT company, {', '.join(f"max({p}) FILTER (metric = '{m}') AS {m}_{p}" for m in names for p in ('n', 'n1'))} FROM {source} GROUP BY 1)"


def _rows(lines: list[tuple[str, str, str, str, str]]) -> str:
    """Report rows of a wide table: label, n, n1, ok_n, ok_n1."""
    return " UNION ALL ".join(f"SELECT company, {i} AS place, '{label.replace("'", "''")}' AS label, ({n})::DOUBLE AS n, ({n1})::DOUBLE AS n1, ({x})::BOOLEAN AS ok_n, ({y})::BOOLEAN AS ok_n1 FROM w" for i, (label, n, n1, x, y) in enumerate(lines))


def _balance() -> str:
    assets = "immobilisations_corporelles immobilisations_financieres stocks creances tresorerie autres_actif".split()
    debts = "capitaux_propres dettes_financieres dettes_exploitation dettes_diverses autres_passif".split()
    names = [*assets, "total_actif", "capital_social", "resultat_exercice", *debts, "total_passif"]
    both = lambda f: (f("n"), f("n1"))
    total = lambda ms, p: " + ".join(f"coalesce({m}_{p}, 0)" for m in ms)
    line = lambda label, m: (label, f"{m}_n", f"{m}_n1", "NULL", "NULL")
    check = lambda label, f: (label, "NULL", "NULL", *both(f))
    rows = [line(*x) for x in zip(("Immobilisations corporelles", "Immobilisations financières", "Stocks", "Créances", "Trésorerie", "Autres éléments d'actif"), assets, strict=True)]
    rows += [("Total Actif", *both(lambda p: total(assets, p)), "NULL", "NULL"), line("Total Actif (source doc)", "total_actif"), line("Capital social", "capital_social"), line("Résultat", "resultat_exercice")]
    rows += [line(*x) for x in zip(("Capitaux propres", "Dettes financières", "Dettes d'exploitation", "Dettes diverses", "Autres éléments de passif"), debts, strict=True)]
    rows += [("Total Passif", *both(lambda p: total(debts, p)), "NULL", "NULL"), line("Total Passif (source doc)", "total_passif")]
    rows += [check("Check équilibre", lambda p: f"abs({total(assets, p)} - ({total(debts, p)})) < 0.005"), check("Check total actif source", lambda p: f"total_actif_{p} IS NULL OR abs({total(assets, p)} - total_actif_{p}) < 0.005")]
    rows += [check("Check total passif source", lambda p: f"total_passif_{p} IS NULL OR abs({total(debts, p)} - total_passif_{p}) < 0.005"), check("Check résultat", lambda p: f"abs(coalesce(capitaux_propres_{p}, 0) - coalesce(capital_social_{p}, 0) - coalesce(resultat_exercice_{p}, 0)) < 0.005")]
    return f"{_wide('mt', names)} {_rows(rows)}"


def _result() -> str:
    names = "chiffre_affaires charges salaires_charges_sociales impots_taxes dotations autres_elements resultat_exploitation resultat_financier resultat_exceptionnel impots_sur_les_societes resultat_net".split()
    said = ("Chiffre d'affaires", "Charges", "Salaires et charges sociales", "Impôts et taxes", "Dotations aux amortissements", "Autres éléments", "Résultat d'exploitation", "Résultat financier", "Résultat exceptionnel", "Impôts sur les sociétés", "Résultat net")
    rows = []
    for label, m in zip(said, names, strict=True):
        rows.append((label, f"{m}_n", f"{m}_n1", "NULL", "NULL"))
        if m in ("resultat_exploitation", "resultat_net"):
            rows.append(("En % du CA", *(f"round(coalesce(coalesce({m}_{p}, 0) / nullif(chiffre_affaires_{p}, 0), 0), 9)" for p in ("n", "n1")), "NULL", "NULL"))
    return f"{_wide('me', names)} {_rows(rows)}"


_TWO = f"""
ts AS (SELECT {_COMPANY} AS company, CASE o_orderkey % 2 WHEN 0 THEN 'compte_resultat' ELSE 'actif' END AS section, {_sql_list(a.ORDER)}[(o_orderkey % 10 + 1)::INT] AS label, o_orderkey, floor(o_totalprice) AS v FROM orders),
td AS (SELECT company, section, CASE WHEN o_orderkey % 5 > 1 THEN '' ELSE 'Document ' END || label AS label, min(o_orderkey) AS ordinal, arg_max(v, o_orderkey) AS n, arg_min(v, o_orderkey) AS n1 FROM ts GROUP BY ALL),
t0 AS (SELECT company, section, CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE 'Registre ' END || label AS label, min(o_orderkey) AS ordinal, arg_max(v, o_orderkey) AS n, arg_min(v, o_orderkey) AS n1 FROM ts GROUP BY ALL),
tr AS (SELECT * FROM t0 UNION ALL SELECT company, section, label, ordinal + 1000000000, n + 1, n1 FROM t0 WHERE ordinal % 4 = 0),
tl AS (SELECT company, section, label, arg_max(n, ordinal) AS n, arg_max(n1, ordinal) AS n1 FROM tr GROUP BY ALL),
fo AS (SELECT td.company, td.section, td.label, td.n AS document_n, td.n1 AS document_n1, tl.n AS registry_n, tl.n1 AS registry_n1, 0 AS side, ordinal FROM td LEFT JOIN tl USING (company, section, label)
  UNION ALL SELECT company, section, label, NULL, NULL, n, n1, 1, ordinal FROM tr ANTI JOIN td USING (company, section, label)),
fc AS (SELECT company, section, label, document_n, document_n1, registry_n, registry_n1, row_number() OVER (PARTITION BY company, section ORDER BY side, ordinal, label)::INT AS place FROM fo)"""
_NOACC = [text_ for text_ in ("chiffre d'affaires", "autres produits d'exploitation", "charges d'exploitation", "charges de personnel", "dotations aux amortissements", "resultat d'exploitation", "resultat financier", "resultat exceptionnel", "impots sur les benefices", "resultat net")]
_FILES_OF = """
cf AS (SELECT doc_id, source || '-' || (doc_id // 500) AS project_id, source || '-' || (doc_id // 500) || '/S' || (doc_id % 9) AS company_folder, CASE WHEN doc_id % 3 > 0 THEN greatest(2018 + doc_id % 6, CASE WHEN doc_id BETWEEN 1900 AND 2199 THEN doc_id ELSE 0 END) END::INT AS year, n_chars AS size, doc_id % 300 AS age,
  '2. Audit/1. Opérateur/' || CASE doc_id % 6 WHEN 0 THEN '3. RH/Dupont Marie' WHEN 1 THEN '4. Bilans/SCI Lumière' WHEN 2 THEN 'Société Emprunteuse' WHEN 3 THEN 'X - Old' WHEN 4 THEN '5. Opération' ELSE 'Annexes' END || '/Doc ' || doc_id || ' ' || (2018 + doc_id % 6) || CASE doc_id % 11 WHEN 0 THEN '.zip' WHEN 1 THEN '.xlsx' ELSE '.pdf' END AS source_path FROM documents)"""
_FILED = """
sp AS (SELECT (100000000 + s_suppkey)::VARCHAR AS siren, (2015 + s_suppkey % 8)::VARCHAR AS year, s_suppkey, floor(s_acctbal) AS v, CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'actif' ELSE 'passif' END WHEN 1 THEN 'actif' ELSE 'passif' END AS side FROM supplier),
fi AS (SELECT siren, year, 0 AS section_index, 0 AS line_index, 'actif' AS side, '010' AS code, 'Ligne plate' AS label, v AS n, NULL::DOUBLE AS n1 FROM sp WHERE s_suppkey % 5 = 0
  UNION ALL SELECT siren, year, 0, 0, side, CASE WHEN s_suppkey % 2 = 0 THEN '028' ELSE '142' END AS code, 'Ligne A' AS label, CASE WHEN side = 'actif' THEN NULL ELSE v END AS n, v AS n1 FROM sp WHERE s_suppkey % 5 > 0
  UNION ALL SELECT siren, year, 0, 1, CASE s_suppkey % 3 WHEN 0 THEN 'annexe' WHEN 1 THEN 'actif' ELSE 'passif' END, 'ZZ', 'Ligne B', v, NULL FROM sp WHERE s_suppkey % 5 > 0
  UNION ALL SELECT siren, year, 1, 0, 'compte_resultat', 'ZZ', 'Ligne B', v, NULL FROM sp WHERE s_suppkey % 5 > 0)"""

SQL = {
    "j3_label_mapping": f"WITH {_WORDS}, {_LINES}, {_mapped('ln')} SELECT ln.table_type, ln.poste, kn.key, kn.is_total, count(*) AS lines FROM ln JOIN kn USING (table_type, poste) GROUP BY ALL",
    "a6_canonical_lines": f"WITH {_CANON} SELECT * FROM ca",
    "a7_keyed_rows": f"""WITH {_WORDS}, {_LINES}, gv AS (SELECT * EXCLUDE (poste), coalesce(nullif(given_key, ''), poste) AS poste FROM (SELECT *, max(coalesce(given_key, '')) OVER (PARTITION BY company, table_type) AS top FROM ln) WHERE top <> ''), {_mapped('gv')}
      SELECT company, table_type, key, n, n1, min(idx) AS idx FROM gv JOIN kn USING (table_type, poste) WHERE key IS NOT NULL GROUP BY ALL""",
    "a8_metrics": f"""WITH {_CANON}, {_metrics()}, tl AS ({_TOLD}), tw AS (SELECT company, regexp_extract(field_id, '^bilan_(.+)_(n1?)$', 1) AS metric, max(replace(value, ' ', '')::DOUBLE) FILTER (field_id LIKE '%\\_n' ESCAPE '\\') AS t_n, max(replace(value, ' ', '')::DOUBLE) FILTER (field_id LIKE '%\\_n1' ESCAPE '\\') AS t_n1
      FROM tl WHERE field_id NOT LIKE '%inconnu%' GROUP BY ALL) SELECT company, metric, coalesce(n, t_n) AS n, coalesce(n1, t_n1) AS n1 FROM me FULL JOIN tw USING (company, metric)""",
    "a9_validation": f'WITH {_CANON}, {_CHECKS} SELECT company, period, "check", lhs, rhs, round(gap, 9) AS gap FROM fl',
    "a10_quality": f"""WITH {_CANON}, {_CHECKS},
      pt AS (SELECT company, table_type, count(*) FILTER (key NOT LIKE 'raw_unmatched_%') AS mapped, count(*) FILTER (key LIKE 'raw_unmatched_%') AS raw, count(*) FILTER (coalesce(n, n1) IS NOT NULL) AS filled, count(*) FILTER (key IN {tuple(a.CRITICAL)}) AS critical,
        count(*) FILTER (abs(n) >= 1e9 OR abs(n1) >= 1e9) AS suspicious FROM ca GROUP BY ALL),
      tn AS (SELECT *, list_position(['actif', 'passif', 'compte_resultat'], table_type) AS k FROM pt),
      rs AS (SELECT company, k, unnest([1, 2, 3]) AS i, unnest([CASE WHEN mapped = 0 AND filled > 0 THEN table_type || ': lignes chiffrées non mappées' END, CASE WHEN raw >= greatest(2, mapped) THEN table_type || ': trop de lignes brutes non mappées' END, CASE WHEN suspicious > 0 THEN table_type || ': montants suspects ou concaténés' END]) AS reason FROM tn),
      rr AS (SELECT company, string_agg(reason, ' ; ' ORDER BY k, i) AS told FROM rs WHERE reason IS NOT NULL GROUP BY 1),
      er AS (SELECT company, sum(CASE WHEN "check" = 'croise' THEN 2 ELSE 1 END) AS errors FROM fl GROUP BY 1),
      tt AS (SELECT company, sum(least(mapped, 8) + 3 * critical - 4 * raw - 8 * suspicious) AS points FROM pt GROUP BY 1),
      tz AS (SELECT company, (points - 6 * coalesce(errors, 0))::BIGINT AS score, coalesce(errors, 0)::BIGINT AS errors, told FROM tt LEFT JOIN er USING (company) LEFT JOIN rr USING (company))
      SELECT company, score, errors, concat_ws(' ; ', told, CASE WHEN errors > 0 THEN errors || ' incohérence(s) comptable(s) détectée(s)' END, CASE WHEN score < 12 THEN 'score global trop faible' END) AS reasons, score < 12 OR errors > 0 OR told IS NOT NULL AS retry FROM tz""",
    "j20_better_answers": f"""WITH e AS ({_ANSWERS}), a AS (SELECT company, field, arg_max_null(value, o_orderkey) AS v FROM e GROUP BY ALL), b AS (SELECT company, field, arg_min_null(value, o_orderkey) AS v FROM e GROUP BY ALL),
      s AS (SELECT company, count(*) FILTER (o_orderkey % 2 = 0) AS s1, count(*) FILTER (o_orderkey % 3 = 0) AS s2 FROM e GROUP BY 1)
      SELECT company, field, CASE WHEN s2 > s1 AND field LIKE 'bilan_%' AND b.v LIKE 'v%' THEN b.v ELSE a.v END AS value FROM a JOIN b USING (company, field) JOIN s USING (company)""",
    "a23_balance_report": f"""WITH {_CANON}, cb AS (SELECT * FROM ca WHERE table_type <> 'compte_resultat'), {_metrics('cb')}, tl AS ({_TOLD}), tw AS (SELECT company, regexp_extract(field_id, '^bilan_(.+)_(n1?)$', 1) AS metric, max(replace(value, ' ', '')::DOUBLE) FILTER (field_id LIKE '%\\_n' ESCAPE '\\') AS t_n, max(replace(value, ' ', '')::DOUBLE) FILTER (field_id LIKE '%\\_n1' ESCAPE '\\') AS t_n1
      FROM tl WHERE field_id NOT LIKE '%inconnu%' GROUP BY ALL), mt AS (SELECT company, metric, coalesce(n, t_n) AS n, coalesce(n1, t_n1) AS n1 FROM me FULL JOIN tw USING (company, metric)),
      {_balance()}""",
    "a24_result_report": f"""WITH {_CANON}, cr AS (SELECT * FROM ca WHERE table_type = 'compte_resultat'), {_metrics('cr')}, {_result()}""",
    "j9_four_columns": f"WITH {_TWO} SELECT * FROM fc",
    "a25_margins": f"""WITH {_TWO}, cr AS (SELECT * FROM fc WHERE section = 'compte_resultat'),
      ag AS (SELECT company, {', '.join(f"max({c}) FILTER (label = 'Chiffre d''affaires') AS ca_{c}, max({c}) FILTER (label = 'Dotations aux amortissements') AS da_{c}" for c in ("document_n", "document_n1", "registry_n", "registry_n1"))} FROM cr GROUP BY 1)
      SELECT company, label, place::DOUBLE AS place, document_n, document_n1, registry_n, registry_n1 FROM cr
      UNION ALL SELECT company, 'EBITDA', place + 0.25, {', '.join(f"CASE WHEN coalesce({c}, da_{c}) IS NOT NULL THEN coalesce({c}, 0) + coalesce(da_{c}, 0) END" for c in ("document_n", "document_n1", "registry_n", "registry_n1"))} FROM cr JOIN ag USING (company) WHERE label = 'Résultat d''exploitation'
      UNION ALL SELECT company, 'En % du CA', place + 0.5, {', '.join(f"round({c} / nullif(ca_{c}, 0), 9)" for c in ("document_n", "document_n1", "registry_n", "registry_n1"))} FROM cr JOIN ag USING (company) WHERE label IN ('Résultat d''exploitation', 'Résultat net')""",
    "o2_statement_order": f"WITH {_LINES} SELECT company, idx, poste, (CASE WHEN list_contains({_sql_list(_NOACC)}, strip_accents(lower(trim(poste)))) THEN list_position({_sql_list(_NOACC)}, strip_accents(lower(trim(poste)))) - 1 ELSE 99 END)::INT AS rank, row_number() OVER (PARTITION BY company ORDER BY idx)::INT AS input_place FROM ln WHERE table_type = 'compte_resultat'",
    "j8_group_values": f"""WITH g AS (SELECT {_COMPANY} AS company, o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN 'B' || (o_orderkey % 12) ELSE '' END AS code, strip_accents(lower({_sql_list(a.ORDER)}[(o_orderkey % 10 + 1)::INT])) AS label, floor(o_totalprice) AS n, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) END AS n1 FROM orders),
      s(label, source) AS (VALUES ('Exploitation', 'B1'), ('Exploitation', 'resultat d''exploitation'), ('Personnel', 'B5'), ('Personnel', 'B7'), ('Rien', 'ZZ')),
      bc AS (SELECT company, code, arg_max_null(n, k) AS n, arg_max_null(n1, k) AS n1 FROM g WHERE code <> '' GROUP BY ALL), bl AS (SELECT company, label, arg_max_null(n, k) AS n, arg_max_null(n1, k) AS n1 FROM g GROUP BY ALL),
      q AS (SELECT c.company, s.label, CASE WHEN bc.code IS NOT NULL THEN bc.n ELSE bl.n END AS n, CASE WHEN bc.code IS NOT NULL THEN bc.n1 ELSE bl.n1 END AS n1 FROM (SELECT DISTINCT company FROM g) c, s LEFT JOIN bc ON bc.company = c.company AND bc.code = s.source LEFT JOIN bl ON bl.company = c.company AND bl.label = s.source)
      SELECT company, label, sum(n)::BIGINT AS n, sum(n1)::BIGINT AS n1 FROM q GROUP BY ALL""",
    "j15_registry_year": f"""WITH d AS (SELECT o_orderkey AS document_id, {_COMPANY} AS company, CASE WHEN o_orderkey % 4 > 0 THEN 2010 + o_orderkey % 15 END AS year FROM orders), f AS (SELECT DISTINCT {_COMPANY} AS company, (2008 + o_orderkey % 13)::INT AS filed FROM orders)
      SELECT document_id, filed AS registry_year FROM d JOIN f USING (company) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN year - filed BETWEEN 1 AND 3 THEN year - filed ELSE 9 END, filed DESC) = 1""",
    "a26_src6_p20_p21_filings": f"WITH {_FILED} SELECT * FROM fi",
    "a26_filing_totals": f"WITH {_FILED} SELECT side, count(*) AS lines, array_to_string(list_sort(list(DISTINCT year)), ',') AS years, sum(n) AS n, sum(n1) AS n1 FROM fi GROUP BY 1",
    "w13_latest_documents": f"WITH {_FILES_OF} SELECT company_folder, source_path, year FROM cf QUALIFY row_number() OVER (PARTITION BY company_folder ORDER BY year DESC NULLS LAST, age DESC, source_path) = 1",
    "a13_latest_year_filter": f"WITH {_FILES_OF}, l AS (SELECT company_folder, max(year) AS last FROM cf GROUP BY 1) SELECT company_folder, last, count(*) AS kept FROM cf JOIN l USING (company_folder) WHERE year IS NULL OR year >= last GROUP BY ALL",
    "a18_company_periods": f"WITH {_FILES_OF}, p AS (SELECT company_folder, CASE WHEN year IS NULL THEN 'Autres bilans' ELSE 'Bilan ' || year END AS period, count(*)::INT AS n, string_agg(name, '; ' ORDER BY coalesce(year, 0) DESC, name DESC, source_path DESC) AS files FROM (SELECT *, regexp_extract(source_path, '[^/]*$') AS name FROM cf) GROUP BY ALL) SELECT company_folder, row_number() OVER (PARTITION BY company_folder ORDER BY period DESC)::INT AS place, period, n, files FROM p",
}
