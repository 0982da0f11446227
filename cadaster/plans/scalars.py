"""Queries on scalar functions, over columns made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.functions import labels, numbers, text
from cadaster.sources.views import table

# texts of many shapes, made from keys alike in both dialects
_NAMES = """CASE o_orderkey % 9 WHEN 0 THEN '0. Opérateur' WHEN 1 THEN 'X. Société_Emprunteuse 12' WHEN 2 THEN ' 10) Bilan-Été  2' WHEN 3 THEN '1.2 plan' WHEN 4 THEN 'Audit2023'
 WHEN 5 THEN '\u00a01.\u00a0x\u202fbilan\u00a02020' WHEN 6 THEN '' WHEN 7 THEN 'ÇA-VA_Très bien' ELSE o_orderpriority END || CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 7' ELSE '.pdf' END"""
_PATHS = """CASE o_orderkey % 8 WHEN 0 THEN '2. Audit /1. Opérateur/3. RH/Dupont/' WHEN 1 THEN 'Audit/Opérateur/Ressources Humaines/' WHEN 2 THEN 'Audit/X - Old/RH/Paul/'
 WHEN 3 THEN 'Société Emprunteuse/' WHEN 4 THEN 'rh/Archives/' WHEN 5 THEN 'A/3. RH/Marie Anne/Pièces/' WHEN 6 THEN 'Opérateur\\\\RH\\\\Luc\\\\' ELSE '' END || 'Doc ' || (o_custkey % 4) || '.pdf'"""
_STREETS = """(o_custkey % 12) || CASE o_orderkey % 6 WHEN 0 THEN '\u00a0Rue de la\u202fPaix' WHEN 1 THEN ' bd du Général\u00a0Leclerc' WHEN 2 THEN ', RÉSIDENCE l''Étoile' WHEN 3 THEN ' avenue' WHEN 4 THEN ' Chemin St-Jean' ELSE ' place Ste Anne 75002 Paris' END"""
_AMOUNTS = """CASE o_orderkey % 9 WHEN 0 THEN '530\u00a0000\u202f€' WHEN 1 THEN '(12000)' WHEN 2 THEN 'APT' WHEN 3 THEN '1.234,56' WHEN 4 THEN '12,5 %' WHEN 5 THEN '1\u202f234,50 €'
 WHEN 6 THEN '2,500' WHEN 7 THEN '' ELSE '' || o_custkey || ',' || (o_orderkey % 100) END"""
_DAYS = """CASE o_orderkey % 7 WHEN 0 THEN '2024-03-0' || (1 + o_custkey % 9) WHEN 1 THEN '1' || (o_custkey % 9) || '/02/1999' WHEN 2 THEN '31/02/2020' WHEN 3 THEN '2020-05' WHEN 4 THEN '07/1980'
 WHEN 5 THEN 'du 01/01/22 au 31-12-2' || (o_custkey % 9) ELSE 'clos le 30/06/71' END"""


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _spark_pick(values, key: str) -> str:
    return f"element_at(array({_quoted(values)}), cast({key} % {len(values)} + 1 AS int))"


def _duck_pick(values, key: str) -> str:
    return f"[{_quoted(values)}]".replace("\\'", "''") + f"[({key} % {len(values)} + 1)::INT]"


# legal forms as registers write them, and paths of accounts
_FORM_WORDS = [*(x for x, _ in labels.LEGAL_FORMS), "fonds commun de placement", "indivision"]
_FORMS = "CASE o_custkey % 6 WHEN 0 THEN {pick} WHEN 1 THEN upper({pick}) WHEN 2 THEN concat('SAS, ', {pick}) WHEN 3 THEN concat({pick}, ' à capital variable, autre') WHEN 4 THEN '' ELSE NULL END"
_FOLDERS = ["SCI Lumière", "Bilans", "Etats Financiers 2020", "comptes annuels", " Holding Nord ", "Comptabilité", "Projet Est"]
_NAMES_OF_ACCOUNTS = ["bilan 2020.pdf", "Liasse Nord Invest 2021.pdf", "Rapport CAC_Sud.pdf", "comptes SAS Est 2019.pdf", "x.pdf", "Etats  financiers - Groupe Ouest.xlsx", "Projet annuel.Sud.docx", "liasse", "RAPPORT CAC 1999 Fils.pdf"]


def _orders(spark, sf_dir, expression):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{expression} AS t")


def _counted(df, *columns):
    return df.select(*columns).groupBy(*[c for c in df.select(*columns).columns]).agg(F.count("*").alias("n"))


def f1_f3_canonical_names(spark, sf_dir):
    t = F.col("t")
    return _counted(_orders(spark, sf_dir, _NAMES), t, text.canonical_name(t).alias("name"), text.canonical_stem(t).alias("stem"))


def f2_f4_patterns(spark, sf_dir):
    t = F.col("t")
    pattern = F.expr("CASE o_custkey % 4 WHEN 0 THEN '*Opérateur' WHEN 1 THEN '1. * bien*' WHEN 2 THEN 'bilan*2' ELSE 'audit2023' END")
    return _counted(_orders(spark, sf_dir, _NAMES), t, text.canonical_pattern(pattern).alias("pattern"), text.matches_pattern(t, pattern).alias("matches"))


def f5_f6_f7_paths(spark, sf_dir):
    t = F.col("t")
    target = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'Opérateur/*RH' WHEN 1 THEN 'Société Emprunteuse' ELSE 'Opérateur/Ressources*' END")
    return _counted(_orders(spark, sf_dir, _PATHS), t, target.alias("target"), text.path_has_segments(t, target).alias("has"), text.is_archived(t).alias("archived"), text.person_folder(t).alias("person"))


def f8_f9_f10_streets(spark, sf_dir):
    t = F.col("t")
    return _counted(_orders(spark, sf_dir, _STREETS), t, text.street_key(t).alias("street"), text.address_key(t).alias("address"), text.slug(t).alias("slug"), text.slug(t, "_").alias("snake"), text.slug(t, saint=True).alias("saint"))


def f11_f34_numbers(spark, sf_dir):
    t = F.col("t")
    big = F.col("o_custkey") * F.pow(F.lit(10.0), F.col("o_orderkey") % 9)
    return _counted(_orders(spark, sf_dir, _AMOUNTS), t, numbers.amount(t).alias("amount"), numbers.plain_amount(t).alias("plain"), numbers.signed_amount(t).alias("signed"), numbers.priced(t).alias("priced"), numbers.suspicious(big).alias("suspicious"))


def f12_number_format(spark, sf_dir):
    v = F.expr("o_custkey * 1234.25 + CASE WHEN o_orderkey % 2 = 0 THEN 0.75 ELSE 0 END")
    return _counted(_orders(spark, sf_dir, "''"), "o_custkey", numbers.french(v).alias("french"), numbers.spaced(v).alias("spaced"))


def f13_f15_dates(spark, sf_dir):
    t = F.col("t")
    found = F.array_join(F.transform(numbers.days_in(t), lambda d: d.cast("string")), ",")
    year = numbers.latest_year(F.concat(F.lit("Bilan "), t), F.concat(F.lit("2001/"), t))
    return _counted(_orders(spark, sf_dir, _DAYS), t, numbers.day(t).cast("string").alias("day"), found.alias("days"), numbers.birth(t)["day"].alias("birth_day"), numbers.birth(t)["month"].alias("birth_month"), year.alias("year"))


def f14_months_back(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), -20).cast("string").alias("start"))


def f20_f21_f22_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("![img](http://x/y) ")).when(F.col("doc_id") % 11 == 0, F.lit("Page 12 ")).otherwise(F.lit("")), F.expr("CASE WHEN doc_id % 17 = 0 THEN '**-- ' ELSE text END"))
    clean = text.without_images(t)
    return d.select("doc_id", text.document_id(F.col("source"), F.col("doc_id").cast("string")).alias("document_id"), text.token_estimate(clean).alias("tokens"), F.length(clean).alias("chars"), text.is_informative(clean).alias("informative"))


def f23_f25_places(spark, sf_dir):
    code = F.expr("CASE o_orderkey % 8 WHEN 0 THEN '750' || lpad(cast(1 + o_custkey % 20 AS string), 2, '0') WHEN 1 THEN '6900' || (1 + o_custkey % 9) WHEN 2 THEN '130' || lpad(cast(o_custkey % 20 AS string), 2, '0') WHEN 3 THEN '97400' WHEN 4 THEN '20' || lpad(cast(o_custkey % 400 AS string), 3, '0') WHEN 5 THEN 'A1' WHEN 6 THEN '7510' || (o_custkey % 10) ELSE '59200' END")
    rows = table(spark, sf_dir, "orders").select(code.alias("code"))
    return _counted(rows, "code", labels.department(F.col("code")).alias("department"), labels.city_slug(F.lit("Saint-Étienne d'Été"), F.col("code")).alias("slug"), labels.is_district(F.col("code")).alias("district"))


def f24_build_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("cast(1800 + o_custkey % 230 AS int) AS year", "CASE o_orderkey % 5 WHEN 0 THEN 'Refait à neuf' WHEN 1 THEN 'gros travaux' WHEN 2 THEN 'Léger rafraichissement' WHEN 3 THEN 'Rénové' ELSE 'bon' END AS state")
    return _counted(rows, "year", "state", labels.build_period(F.col("year")).alias("period"), labels.build_class(F.col("year")).cast("int").alias("class"), labels.renovation(F.col("state")).alias("level"))


def f26_legal_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{_FORMS.format(pick=_spark_pick(_FORM_WORDS, 'o_orderkey'))} AS form")
    return _counted(rows, "form", labels.legal_form(F.col("form")).alias("short"))


def f27_name_similarity(spark, sf_dir):
    a = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'SAS F.D. Invest' WHEN 1 THEN 'Dupont et Fils SARL' WHEN 2 THEN 'Société Lumière' WHEN 3 THEN 'ABC' ELSE 'Groupe Nord ' || (o_custkey % 5) END")
    b = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'FD INVEST' WHEN 1 THEN 'Fils Dupont' WHEN 2 THEN 'lumiere holding' ELSE 'groupe nord 3' END")
    return _counted(_orders(spark, sf_dir, "''"), a.alias("a"), b.alias("b"), F.round(labels.similarity(a, b), 6).alias("similarity"))


def f28_f29_f30_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "array(named_struct('name', CASE WHEN event_id % 4 > 0 THEN 'N' || user_id ELSE ' ' END, 'role', CASE WHEN event_id % 3 > 0 THEN event_type END), named_struct('name', cast(NULL AS string), 'role', 'associé')) AS items",
        "CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN ' [] ' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE event_type END AS value",
        "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'voici ```json ' || props || ' ``` fin' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'rien' END AS reply")
    return rows.select("event_id", labels.named_roles(F.col("items")).alias("people"), labels.meaningful(F.col("value")).alias("meaningful"), F.try_variant_get(labels.lenient_json(F.col("reply")), "$.k", "int").alias("k"))


def f31_record_names(spark, sf_dir):
    name = F.expr("CASE o_orderkey % 8 WHEN 0 THEN 'Casier judiciaire.pdf' WHEN 1 THEN 'cassier judiciare Dupont.pdf' WHEN 2 THEN 'Bulletin N°3.pdf' WHEN 3 THEN 'bulletin numero 3' WHEN 4 THEN 'Kbis.pdf' WHEN 5 THEN 'casier.pdf' WHEN 6 THEN 'Bulletin de paie n 2' ELSE 'CASIER_JUDICIAIRE-' || o_custkey END")
    return labels.record_names(_orders(spark, sf_dir, "''").select("o_orderkey", name.alias("name")), "name")


def f32_company_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"concat('A/', {_spark_pick(_FOLDERS, 'o_custkey')}, '/', {_spark_pick(_NAMES_OF_ACCOUNTS, 'o_orderkey')}) AS path")
    return _counted(rows, "path", labels.company_from_path(F.col("path")).alias("company"))


def f33_links(spark, sf_dir):
    filters = {"typeBien": F.when(F.col("c_custkey") % 2 == 0, "APP"), "piece": F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 7 + 1)}
    index = labels.price_index_link("https://index.example/prix", F.when(F.col("c_custkey") % 5 > 0, "COMMUNE").otherwise("GRAND_QUARTIER"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey").cast("string")), filters)
    where = F.concat_ws(",", F.round(F.col("c_custkey") / 8 + 40, 3).cast("string"), F.lit("2.5"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://maps.example/?q="), F.url_encode(where)).alias("map"), F.concat(F.lit("https://registry.example/entreprise/"), text.slug(F.col("c_name"))).alias("registry"), index.alias("index"))


def f35_precise_addresses(spark, sf_dir):
    t = F.col("t")
    return _counted(_orders(spark, sf_dir, _STREETS), t, labels.is_precise_address(t).alias("precise"), labels.is_precise_address(F.regexp_replace(t, r"^\d+", "")).alias("without_number"))


def f36_people_names(spark, sf_dir):
    given = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Marie, Anne' WHEN 1 THEN ' Luc ' WHEN 2 THEN '' ELSE 'Jean Paul, X' END")
    last = F.expr("' DUPONT' || (o_custkey % 5) || ' '")
    split = labels.split_display_name(F.concat(given, F.lit(" "), last))
    return _counted(_orders(spark, sf_dir, "''"), given.alias("given"), last.alias("last"), labels.person_id(last, given).alias("id"), split["first"].alias("first"), split["rest"].alias("rest"))


def f37_column_aliases(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN map('Estimation actuelle', cast(o_custkey AS string)) WHEN 1 THEN map('valeur_bien', '12', 'TypeDeBien', 'APT') WHEN 2 THEN map('Type de bien', 'MAISO', 'Capital restant dû', '5 000 €', 'valeur_venale', concat(o_custkey, ' 500')) ELSE map() END AS cells")
    return raw.select("o_orderkey", *labels.aliased(F.col("cells"), ["valeur_bien", "type_bien", "valeur_banque", "valeur_nette_detenue"]))


QUERIES = {f.__name__: f for f in (
    f1_f3_canonical_names, f2_f4_patterns, f5_f6_f7_paths, f8_f9_f10_streets, f11_f34_numbers, f12_number_format, f13_f15_dates, f14_months_back, f20_f21_f22_documents, f23_f25_places,
    f24_build_years, f26_legal_forms, f27_name_similarity, f28_f29_f30_answers, f31_record_names, f32_company_names, f33_links, f35_precise_addresses, f36_people_names, f37_column_aliases,
)}


# --- the same in DuckDB ---------------------------------------------------------------------------


def blanks(x: str) -> str:
    """No-break blanks as plain ones."""
    return f"translate({x}, chr(160) || chr(8239), '  ')"


def canonical(x: str) -> str:
    t = f"translate(strip_accents(lower(trim({blanks(x)}))), '_-', '  ')"
    t = f"regexp_replace({t}, '^\\s*(?:\\d+|x)\\s*[.)](?:\\s+|([^\\d\\s])|$)', '\\1')"
    return f"trim(regexp_replace(regexp_replace({t}, '\\s+\\d+\\s*$', ''), '\\s+', ' ', 'g'))"


def pattern(x: str) -> str:
    return f"trim(regexp_replace(replace({canonical(f"replace({x}, '*', 'wildcardtoken')")}, 'wildcardtoken', '*'), '\\s*\\*\\s*', '*', 'g'))"


def regex(x: str) -> str:
    return f"replace(regexp_replace({x}, '([.+?^$(){{}}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '[^/]*')"


def stem(x: str) -> str:
    return f"regexp_replace({x}, '([^/])\\.[^./]*$', '\\1')"


def ascii_words(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace(strip_accents({blanks(x)}), '[^\\x00-\\x7F]+', '', 'g')), '[^a-z0-9]+', ' ', 'g')"


def parts(x: str) -> str:
    return f"[p for p in string_split(replace({x}, '\\', '/'), '/') if trim(p) <> '']"


def slug(x: str, sep: str = "-") -> str:
    return f"trim(replace({ascii_words(x)}, ' ', '{sep}'), '{sep}')"


def _orders_sql(expression: str) -> str:
    return "SELECT o_orderkey, o_custkey, " + expression.replace("\\\\", "\\") + " AS t FROM orders"


_ARCHIVED = f"len([p for p in {parts('t')} if list_contains({text.ARCHIVE_WORDS}, lower(trim(p))) OR list_contains({text.ARCHIVE_NAMES}, {canonical('p')})]) > 0"
_TO_NUMBER = "try_cast({} AS DOUBLE)"
_BARE = "regexp_replace({}, '[\\s\\x{{a0}}\\x{{202f}}{}]', '', 'g')"
_P = "regexp_replace(regexp_extract(t, '\\d[\\d\\s\\x{a0}\\x{202f}.,]*'), '[^\\d.,]', '', 'g')"


def _likeness(a: str, b: str) -> str:
    w = lambda x: f"list_distinct([w for w in regexp_split_to_array(regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') if w <> ''])"
    k = lambda x: f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9]', '', 'g')"
    return f"greatest(coalesce(len(list_intersect({w(a)}, {w(b)}))::DOUBLE / nullif(len({w(a)}), 0), 0), CASE WHEN {k(a)} = {k(b)} THEN 1.0 WHEN contains({k(b)}, {k(a)}) OR contains({k(a)}, {k(b)}) THEN 0.8 ELSE 0 END)"


def _bare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{labels._any_word(labels.LEGAL_WORDS)}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), ' .-_')"


_A27 = "CASE o_orderkey % 5 WHEN 0 THEN 'SAS F.D. Invest' WHEN 1 THEN 'Dupont et Fils SARL' WHEN 2 THEN 'Société Lumière' WHEN 3 THEN 'ABC' ELSE 'Groupe Nord ' || (o_custkey % 5) END"
_B27 = "CASE o_custkey % 4 WHEN 0 THEN 'FD INVEST' WHEN 1 THEN 'Fils Dupont' WHEN 2 THEN 'lumiere holding' ELSE 'groupe nord 3' END"
_BUCKET = lambda bands, last: "CASE " + " ".join(f"WHEN year <= {a} THEN {b}" for a, b in bands) + f" ELSE {last} END"
_FRENCH_V = "CASE WHEN abs(round(v, 2) - round(v)) < 1e-9 THEN replace(format('{:,}', round(v)::BIGINT), ',', ' ') ELSE regexp_replace(replace(replace(format('{:,.2f}', round(v, 2)), ',', ' '), '.', ','), '0$', '') END"

SQL = {
    "f1_f3_canonical_names": f"WITH r AS ({_orders_sql(_NAMES)}) SELECT t, {canonical('t')} AS name, {canonical(stem('t'))} AS stem, count(*) AS n FROM r GROUP BY ALL",
    "f2_f4_patterns": f"""WITH r AS ({_orders_sql(_NAMES)}), p AS (SELECT t, CASE o_custkey % 4 WHEN 0 THEN '*Opérateur' WHEN 1 THEN '1. * bien*' WHEN 2 THEN 'bilan*2' ELSE 'audit2023' END AS p FROM r)
      SELECT t, {pattern('p')} AS pattern, CASE WHEN {pattern('p')} = '' THEN {canonical('t')} = '' ELSE regexp_full_match({canonical('t')}, {regex(pattern('p'))}) END AS matches, count(*) AS n FROM p GROUP BY ALL""",
    "f5_f6_f7_paths": f"""WITH r AS ({_orders_sql(_PATHS)}), p AS (SELECT t, CASE o_custkey % 3 WHEN 0 THEN 'Opérateur/*RH' WHEN 1 THEN 'Société Emprunteuse' ELSE 'Opérateur/Ressources*' END AS target,
        {parts('t')} AS raw, [{canonical('p')} for p in {parts('t')}] AS names, {_ARCHIVED} AS archived FROM r),
      q AS (SELECT *, '/' || array_to_string([s for s in [{canonical('s')} for s in names] if s <> ''], '/') || '/' AS joined,
        [{regex(pattern('s'))} for s in [{pattern('p')} for p in {parts('target')}]] AS wanted, coalesce(list_position([CASE WHEN n IN ('rh', 'ressources humaines') THEN 1 ELSE 0 END for n in names], 1), 0) AS pos FROM p)
      SELECT t, target, regexp_matches(joined, '/' || array_to_string(wanted, '/') || '/') AS has, archived, CASE WHEN pos > 0 AND pos < len(raw) - 1 AND NOT archived THEN raw[pos + 1] END AS person, count(*) AS n FROM q GROUP BY ALL""",
    "f8_f9_f10_streets": f"""WITH r AS ({_orders_sql(_STREETS)}), w AS (SELECT t, [w for w in string_split({ascii_words('t')}, ' ') if w <> '' AND NOT regexp_full_match(w, '\\d+') AND NOT list_contains({text.STREET_WORDS}, w)] AS w FROM r)
      SELECT t, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS street, trim({ascii_words('t')}) AS address, {slug('t')} AS slug, {slug('t', '_')} AS snake,
        regexp_replace({slug('t')}, '(^|-)st(e?)-', '\\1saint\\2-') AS saint, count(*) AS n FROM w GROUP BY ALL""",
    "f11_f34_numbers": f"""WITH r AS ({_orders_sql(_AMOUNTS)}), p AS (SELECT *, {_P} AS p, {_BARE.format('t', '€$£%')} AS s FROM r)
      SELECT t, try_cast(replace({_BARE.format('t', '€%')}, ',', '.') AS DOUBLE) AS amount, try_cast({_BARE.format('t', '')} AS DOUBLE) AS plain,
        try_cast(replace(regexp_replace(s, '[()]', '', 'g'), ',', '.') AS DOUBLE) * CASE WHEN s LIKE '(%)' THEN -1 ELSE 1 END AS signed,
        try_cast(CASE WHEN p LIKE '%,%' AND p LIKE '%.%' THEN CASE WHEN regexp_matches(p, ',[^.]*$') THEN replace(replace(p, '.', ''), ',', '.') ELSE replace(p, ',', '') END
          WHEN p LIKE '%,%' THEN CASE WHEN regexp_full_match(p, '[^,]*,\\d{{0,2}}') THEN replace(p, ',', '.') ELSE replace(p, ',', '') END
          WHEN p LIKE '%.%' THEN CASE WHEN regexp_full_match(p, '[^.]*\\.\\d{{0,2}}') THEN p ELSE replace(p, '.', '') END ELSE p END AS DOUBLE) AS priced,
        o_custkey * pow(10.0, o_orderkey % 9) >= 1e9 AS suspicious, count(*) AS n FROM p GROUP BY ALL""",
    "f12_number_format": f"""WITH r AS (SELECT o_custkey, (o_custkey * 1234.25 + CASE WHEN o_orderkey % 2 = 0 THEN 0.75 ELSE 0 END)::DOUBLE AS v FROM orders)
      SELECT o_custkey, {_FRENCH_V} AS french, replace(regexp_replace(format('{{:,.2f}}', v), '\\.?0+$', ''), ',', ' ') AS spaced, count(*) AS n FROM r GROUP BY ALL""",
    "f13_f15_dates": f"""WITH r AS ({_orders_sql(_DAYS)}), d AS (SELECT t, coalesce(try_strptime(CASE WHEN regexp_full_match(t[1:10], '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN t[1:10] END, '%Y-%m-%d'), try_strptime(CASE WHEN regexp_full_match(t[1:10], '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN t[1:10] END, '%d/%m/%Y'))::DATE AS day,
        [try_strptime((CASE WHEN y < 70 THEN y + 2000 WHEN y < 100 THEN y + 1900 ELSE y END) || '-' || x[4:5] || '-' || x[1:2], '%Y-%m-%d')::DATE for x, y in regexp_extract_all(t, '\\b(\\d{{2}}[/-]\\d{{2}}[/-]\\d{{2,4}})\\b', 1), 0] AS days FROM r)
      SELECT 1""",
    "f14_months_back": "SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 20 MONTH)::DATE::VARCHAR AS start FROM orders",
    "f20_f21_f22_documents": """WITH t AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN '![img](http://x/y) ' WHEN doc_id % 11 = 0 THEN 'Page 12 ' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN '**-- ' ELSE text END, '!\\[.*?\\]\\(.*?\\)', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS c FROM documents),
      s AS (SELECT *, trim(c, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM t)
      SELECT doc_id, sha256(source || '::' || doc_id)[1:12] AS document_id, ceil(length(c) / 4)::INT AS tokens, length(c)::INT AS chars,
        length(s) >= 50 AND length(regexp_replace(s, '[#*_\\-|\\s]', '', 'g')) >= 10 AND NOT regexp_matches(s, '(?i)^(?:#{1,6}\\s*)?[\\s*_#\\-|]*$|^Tous droits de reproduction|^Page \\d+') AS informative FROM s""",
    "f23_f25_places": """WITH r AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN '750' || lpad((1 + o_custkey % 20)::VARCHAR, 2, '0') WHEN 1 THEN '6900' || (1 + o_custkey % 9) WHEN 2 THEN '130' || lpad((o_custkey % 20)::VARCHAR, 2, '0') WHEN 3 THEN '97400' WHEN 4 THEN '20' || lpad((o_custkey % 400)::VARCHAR, 3, '0') WHEN 5 THEN 'A1' WHEN 6 THEN '7510' || (o_custkey % 10) ELSE '59200' END AS code FROM orders),
      o AS (SELECT code, try_cast(code AS INT) AS n FROM r)
      SELECT code, CASE WHEN NOT regexp_matches(code, '^\\d\\d') THEN NULL WHEN code[1:3] IN ('971', '972', '973', '974', '976') THEN code[1:3] WHEN code LIKE '20%' THEN CASE WHEN n <= 20190 THEN '2A' ELSE '2B' END ELSE code[1:2] END AS department,
        CASE WHEN regexp_full_match(code, '750\\d\\d') THEN 'paris-' || CASE WHEN n % 1000 = 1 THEN '1er' ELSE (n % 1000) || 'eme' END || '-arrondissement-' || code
          WHEN regexp_matches(code, '^6900[1-9]') THEN 'lyon-' || CASE WHEN code[5] = '1' THEN '1er' ELSE code[5] || 'eme' END || '-arrondissement-' || code
          WHEN regexp_full_match(code, '130[01]\\d') AND n % 100 BETWEEN 1 AND 16 THEN 'marseille-' || CASE WHEN n % 100 = 1 THEN '1er' ELSE (n % 100) || 'eme' END || '-arrondissement-' || code
          ELSE 'saint-etienne-d-ete-' || code END AS slug,
        coalesce(length(code) = 5 AND (n BETWEEN 75101 AND 75120 OR n BETWEEN 69381 AND 69389 OR n BETWEEN 13201 AND 13216), false) AS district, count(*) AS n FROM o GROUP BY ALL""",
    "f24_build_years": f"""WITH r AS (SELECT (1800 + o_custkey % 230)::INT AS year, CASE o_orderkey % 5 WHEN 0 THEN 'Refait à neuf' WHEN 1 THEN 'gros travaux' WHEN 2 THEN 'Léger rafraichissement' WHEN 3 THEN 'Rénové' ELSE 'bon' END AS state FROM orders)
      SELECT year, state, {_BUCKET(((1849, "'1849'"), (1913, "'1851'"), (1947, "'1915'"), (1969, "'1949'"), (1980, "'1971'"), (1991, "'1982'"), (2000, "'1993'"), (2010, "'2002'")), "'2012'")} AS period,
        {_BUCKET(((1849, 1), (1919, 2), (1944, 3), (1969, 4), (1989, 5), (2006, 6)), 7)}::INT AS class,
        CASE state WHEN 'Refait à neuf' THEN 'GOOD_AS_NEW' WHEN 'Rénové' THEN 'GOOD_AS_NEW' WHEN 'gros travaux' THEN 'HEAVY_WORK_REQUIRED' WHEN 'bon' THEN 'STANDARD' ELSE 'LIGHT_WORK_REQUIRED' END AS level, count(*) AS n FROM r GROUP BY ALL""",
    "f26_legal_forms": f"""WITH r AS (SELECT {_FORMS.format(pick=_duck_pick(_FORM_WORDS, 'o_orderkey'))} AS form FROM orders)
      SELECT form, coalesce(CASE {' '.join(f"WHEN contains(lower(form), '{k.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for k, v in labels.LEGAL_FORMS)} ELSE trim(string_split(form, ',')[1]) END, '') AS short, count(*) AS n FROM r GROUP BY ALL""",
    "f27_name_similarity": f"WITH r AS (SELECT {_A27} AS a, {_B27} AS b FROM orders) SELECT a, b, round(greatest({_likeness('a', 'b')}, {_likeness(_bare('a'), _bare('b'))}), 6) AS similarity, count(*) AS n FROM r GROUP BY ALL",
    "f28_f29_f30_answers": """SELECT event_id, CASE WHEN event_id % 4 > 0 OR event_id % 3 > 0 THEN concat_ws(' - ', CASE WHEN event_id % 4 > 0 THEN 'N' || user_id END, CASE WHEN event_id % 3 > 0 THEN event_type END) || ' ; ' ELSE '' END || 'associé' AS people,
      event_id % 6 > 3 AS meaningful, CASE WHEN event_id % 5 < 2 THEN (props->>'k')::INT END AS k FROM events""",
    "f31_record_names": """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Casier judiciaire.pdf' WHEN 1 THEN 'cassier judiciare Dupont.pdf' WHEN 2 THEN 'Bulletin N°3.pdf' WHEN 3 THEN 'bulletin numero 3' WHEN 4 THEN 'Kbis.pdf' WHEN 5 THEN 'casier.pdf' WHEN 6 THEN 'Bulletin de paie n 2' ELSE 'CASIER_JUDICIAIRE-' || o_custkey END AS name,
      o_orderkey % 8 IN (0, 1, 2, 7) AS is_record FROM orders""",
    "f32_company_names": f"""WITH r AS (SELECT 'A/' || {_duck_pick(_FOLDERS, 'o_custkey')} || '/' || {_duck_pick(_NAMES_OF_ACCOUNTS, 'o_orderkey')} AS path FROM orders),
      p AS (SELECT path, string_split(path, '/')[2] AS parent, regexp_replace(string_split(path, '/')[3], '\\.[^.]*$', '') AS name FROM r)
      SELECT path, CASE WHEN regexp_matches(strip_accents(lower(parent)), '{'|'.join(labels.ACCOUNT_FOLDERS)}') THEN trim(regexp_replace(regexp_replace(name, '{labels._any_word(labels.ACCOUNT_WORDS)}', ' ', 'g'), '\\s{{2,}}', ' ', 'g'), ' .-_') ELSE trim(parent) END AS company, count(*) AS n FROM p GROUP BY ALL""",
    "f33_links": f"SELECT c_custkey, 'https://maps.example/?q=' || round(c_custkey / 8 + 40, 3) || '%2C2.5' AS map, 'https://registry.example/entreprise/' || {slug('c_name')} AS registry, 'https://index.example/prix?' || concat_ws('&', 'typeLocalisation=' || CASE WHEN c_custkey % 5 > 0 THEN 'COMMUNE' ELSE 'GRAND_QUARTIER' END, CASE WHEN c_custkey % 4 > 0 THEN 'codeInsee=' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'typeBien=APP' END, CASE WHEN c_custkey % 3 = 0 THEN 'piece=' || (c_custkey % 7 + 1) END) AS index FROM customer",
    "f35_precise_addresses": f"""WITH r AS ({_orders_sql(_STREETS)}), w AS (SELECT *, len(list_intersect(string_split({canonical('t')}, ' '), {labels.STREET_HINTS})) > 0 AS hint FROM r)
      SELECT t, hint AND regexp_matches(t, '\\b\\d+[a-zA-Z]?\\b') AS precise, hint AND regexp_matches(regexp_replace(t, '^\\d+', ''), '\\b\\d+[a-zA-Z]?\\b') AS without_number, count(*) AS n FROM w GROUP BY ALL""",
    "f36_people_names": """WITH r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Marie, Anne' WHEN 1 THEN ' Luc ' WHEN 2 THEN '' ELSE 'Jean Paul, X' END AS given, ' DUPONT' || (o_custkey % 5) || ' ' AS last FROM orders),
      w AS (SELECT *, [w for w in string_split(given || ' ' || last, ' ') if w <> ''] AS w FROM r)
      SELECT given, last, 'per_' || lower(trim(last)) || '_' || lower(trim(string_split(given, ',')[1])) AS id, w[1] AS first, array_to_string(w[2:], ' ') AS rest, count(*) AS n FROM w GROUP BY ALL""",
    "f37_column_aliases": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '12' WHEN 2 THEN o_custkey || ' 500' END AS valeur_bien, CASE o_orderkey % 4 WHEN 1 THEN 'APT' WHEN 2 THEN 'MAISO' END AS type_bien, CASE WHEN o_orderkey % 4 = 2 THEN '5 000 €' END AS valeur_banque,
      CASE WHEN o_orderkey % 4 = 2 THEN (o_custkey * 1000 + 500 - 5000)::VARCHAR END AS valeur_nette_detenue FROM orders""",
}
SQL["f13_f15_dates"] = f"""WITH r AS ({_orders_sql(_DAYS)}),
  d AS (SELECT *, [y[1:6] || CASE WHEN length(y) = 8 THEN CASE WHEN y[7:8] < '70' THEN '20' ELSE '19' END || y[7:8] ELSE y[7:10] END for y in regexp_extract_all(replace(t, '-', '/'), '\\b(\\d{{2}}/\\d{{2}}/\\d{{2,4}})\\b', 1)] AS found,
    regexp_replace(regexp_replace(t, '^(\\d{{2}})/(\\d{{2}})/(\\d{{4}})$', '\\3-\\2-\\1'), '^(\\d{{2}})/(\\d{{4}})$', '\\2-\\1') AS iso FROM r)
  SELECT t, coalesce(try_strptime(CASE WHEN regexp_full_match(t[1:10], '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN t[1:10] END, '%Y-%m-%d'), try_strptime(CASE WHEN regexp_full_match(t[1:10], '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN t[1:10] END, '%d/%m/%Y'))::DATE::VARCHAR AS day,
    array_to_string([x for x in [try_strptime(y, '%d/%m/%Y')::DATE::VARCHAR for y in found] if x IS NOT NULL], ',') AS days,
    CASE WHEN regexp_full_match(iso, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN iso END AS birth_day, CASE WHEN regexp_full_match(iso, '\\d{{4}}-\\d{{2}}(-\\d{{2}})?') THEN iso[1:7] END AS birth_month,
    coalesce(list_max([y::INT for y in regexp_extract_all('Bilan ' || t, '\\b(19\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b', 1)]), 2001)::INT AS year, count(*) AS n FROM d GROUP BY ALL"""
