"""Queries on question rules and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadaster.functions import numbers, text
from cadaster.operators import answers as a
from cadaster.plans.corpus import FILES
from cadaster.plans.scalars import canonical, parts, pattern, regex, stem
from cadaster.sources import inventory
from cadaster.sources.views import answers, files, table

RULES = [
    ("doc_any", [], ["doc"]), ("bilan_actif_table", ["Opérateur/*Bilans"], ["bilan", "lumière"]), ("rh_casier", ["*Opérateur/3. RH"], ["dupont", "casier"]), ("empty", [], [""]),
    ("emprunt", ["Société Emprunteuse"], ["2019", "2021"]), ("operation", ["*Opération"], ["zzz"]),
]

#: Folders that result files are dealt to by their projects.
PROJECT_GROUPS = 64


def _rules(spark):
    return spark.createDataFrame(RULES, "field_id string, source_dirs array<string>, hint_keywords array<string>")


def p1_scope(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("source_path", F.when(F.col("doc_id") % 4 == 0, F.replace("source_path", F.lit("1. Opérateur"), F.lit("9. Divers"))).otherwise(F.col("source_path")))
    return rows.select("doc_id", a.in_scope(F.col("source_path"), F.when(F.col("doc_id") % 3 == 0, "2. AUDIT/9. Divers/annexes")).alias("kept"))


def j1_matched_rules(spark, sf_dir):
    return a.match_rules(files(spark, sf_dir), _rules(spark)).select("doc_id", "field_id")


def p2_prefilter(spark, sf_dir):
    rows = files(spark, sf_dir).join(a.match_rules(files(spark, sf_dir), _rules(spark)).groupBy("doc_id").agg(F.count("*").alias("hits")), "doc_id", "left")
    record = F.rlike(text.canonical_name(F.col("filename")), F.lit(r"\bdoc 7\d*\b"))
    reasons = a.keep_reasons(F.col("source_path"), F.col("filename"), F.coalesce("hits", F.lit(0)), F.lit(["2. Audit/1. Opérateur/4. Bilans"]), record)
    return rows.select("doc_id", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def p3_excluded(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", a.excluded(F.col("source_path"), ["lumiere", "", "annexes", "x - old"]).alias("excluded"))


def p4_resolved_dirs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 > 0 THEN concat('Audit ', o_custkey % 4) END AS chosen", "array('{selected_audit_folder}/RH', concat('2. Audit/*Opérateur/', CASE WHEN o_orderkey % 2 = 0 THEN 'RH' ELSE 'Kbis' END), 'Audit 1/RH', 'a/*') AS dirs")
    dirs = a.resolve_dirs(F.col("dirs"), F.col("chosen"))
    return rows.select("o_orderkey", F.array_join(dirs, "|").alias("dirs"), F.array_join(F.filter(dirs, a.is_specific), "|").alias("specific"))


def p11_p12_tabs_and_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_id % 6 WHEN 0 THEN 'bilan_actif_table' WHEN 1 THEN 'bilan_compte_resultat_table' WHEN 2 THEN 'bilan_societe_nom' WHEN 3 THEN 'lots_table' ELSE event_type END AS field_id", "CASE event_id % 5 WHEN 0 THEN '{person_name}' WHEN 1 THEN '{company_name}' WHEN 2 THEN 'Commercialisation' WHEN 3 THEN 'Projet' END AS sheet")
    t = a.tabs(F.col("field_id"), F.col("sheet"))
    return rows.select("event_id", F.array_join(t, ",").alias("tabs"), a.scope(F.col("sheet")).alias("scope"), F.arrays_overlap(t, F.lit(["bilan", "lots"])).alias("wanted"))


def _asked(spark, sf_dir):
    return answers(spark, sf_dir).select("project_id", "field_id", "entity_key", F.when(F.col("entity_key") == "e0", "global").when(F.col("entity_key") == "e1", "person").otherwise("company").alias("scope"), F.floor(F.col("document_id") / 4).alias("document_id"))


def p13_field_statuses(spark, sf_dir):
    field = F.when(F.col("document_id") % 4 > 0, F.col("field_id")).otherwise(F.concat(F.lit("other "), "field_id"))
    given = answers(spark, sf_dir).withColumn("field_id", field).withColumn("document_id", F.floor(F.col("document_id") / 4))
    return a.statuses(_asked(spark, sf_dir), given)


def w4_first_answers(spark, sf_dir):
    return a.consolidate(answers(spark, sf_dir))


def w5_entity_index(spark, sf_dir):
    return a.entity_index(answers(spark, sf_dir).withColumn("entity_key", F.concat("entity_key", F.lit("-"), F.col("document_id") % 7)))


def a12_extraction_summary(spark, sf_dir):
    return a.extraction_summary(_asked(spark, sf_dir), answers(spark, sf_dir).withColumn("value", F.when(F.col("document_id") % 11 == 0, F.col("value"))))


def j13_filled_answers(spark, sf_dir):
    given = answers(spark, sf_dir).groupBy(F.floor(F.col("document_id") / 4).alias("document_id"), "field_id").agg(F.max("value").alias("value"))
    # each side has documents that the others have not
    shared = lambda df, k: df.withColumn("document_id", F.when(F.col("document_id") % k[0] == 0, F.col("document_id") + k[1]).otherwise(F.col("document_id")))
    native = shared(given, (3, 10**9)).select("document_id", "field_id", F.lit("natif").alias("value"))
    return a.fill_missing(shared(given, (2, 2 * 10**9)), native, shared(_asked(spark, sf_dir), (5, 3 * 10**9)))


def j14_project_location(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("concat('p', cast(floor(o_custkey / 10) AS int)) AS project_id", "o_orderkey % 50 AS document_id", "o_orderkey AS ordinal", "CASE o_orderkey % 5 WHEN 0 THEN concat(o_custkey % 9, ' Rue de la Paix') WHEN 1 THEN concat(o_custkey % 9, ' rue de la paix 75002 Paris') WHEN 2 THEN 'Paris' WHEN 3 THEN concat(o_orderkey % 17, ' avenue Foch') ELSE NULL END AS value")
    return a.project_location(rows)


def p14_operation_view(spark, sf_dir):
    names = F.lit([*a.SUMMARY, "taux_emprunt", "garantie_operation", "autre"])
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.floor(F.col("user_id") / 3)).alias("project_id"), F.get(names, (F.col("event_id") % 13).cast("int")).alias("field_id"), F.when(F.col("event_id") % 4 > 0, F.col("event_id").cast("string")).alias("value"))
    return a.operation_view(rows.groupBy("project_id", "field_id").agg(F.max("value").alias("value")))


def a28_export_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("user_id")).alias("project_id"), "event_type")
    return a.export_status(e.select("project_id").distinct(), operation=e.where("event_type = 'click'"), financier=e.where("event_type = 'error'"), scraping=e.where("event_type = 'purchase' AND project_id LIKE '%1%'"))


def j21_selected_files(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("project_id").alias("company"), "source_path", numbers.latest_year(F.regexp_replace("filename", r"\.\w+$", ""), F.lit("")).alias("year"), "doc_id")
    chosen = f.where("doc_id % 37 = 0").select("company", F.when(F.col("doc_id") % 2 == 0, F.col("source_path")).otherwise(F.lit("absent")).alias("source_path"))
    return a.with_default_selection(f.select("company", "source_path", "year"), chosen)


def w18_newest_history(spark, sf_dir):
    return a.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"]).select("event_id", "user_id", "place")


def src1_rule_files(spark, sf_dir):
    """Rules of parts, in files of some thousands, read back; those without an id are left out."""
    path = inventory.shared_folder(spark, "rules")
    field = F.struct(F.when(F.col("p_partkey") % 9 > 0, F.concat(F.lit("f"), F.col("p_partkey"))).alias("field_id"), F.col("p_name").alias("label"), F.array("p_type").alias("hint_keywords"))
    table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20_000)).agg(F.collect_list(field).alias("fields")).select("fields").write.option("maxRecordsPerFile", 1).json(path)
    return inventory.rules(spark, path).select("field_id", "label", F.get("hint_keywords", 0).alias("hint"))


def src3_whole_texts(spark, sf_dir):
    """Texts of each source, in files of some ten megabytes each, read back whole: as many files as the documents need."""
    path = inventory.shared_folder(spark, "texts")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n")
    table(spark, sf_dir, "documents").groupBy("source", F.floor(F.col("doc_id") / 4096)).agg(joined.alias("text")).select("text").write.option("maxRecordsPerFile", 1).text(path)
    return inventory.whole_texts(spark, path).select("file_type", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def src5_manifests(spark, sf_dir):
    """Manifests of each project, one file each, written and read back by cache key."""
    path = inventory.shared_folder(spark, "manifests")
    entry = F.struct(F.when(F.col("doc_id") % 13 > 0, F.col("source_path")).alias("source_path"), F.when(F.col("doc_id") % 17 > 0, F.col("file_size_bytes").cast("string")).otherwise("?").alias("file_size_bytes"))
    files(spark, sf_dir).groupBy("project_id").agg(F.collect_list(entry).alias("files")).write.option("maxRecordsPerFile", 1).json(path)
    return inventory.manifest(spark, path).select("project_id", "cache_key")


def src4_src9_chunk_files(spark, sf_dir):
    """Chunk rows written as JSON lines by project and read back."""
    path = inventory.shared_folder(spark, "chunks")
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("document_id"), "text")
    inventory.write_chunks(chunks, path)
    return inventory.read_chunks(spark, path, "document_id long, text string, project_id string").groupBy("project_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def src9_result_files(spark, sf_dir):
    """Consolidated answers as JSON lines by groups of projects and statuses as Parquet, written and read back.

    A project's answers are in one file; a folder for each project would cost the driver a commit and a listing each.
    """
    folder = inventory.shared_folder(spark, "results")
    given = a.consolidate(answers(spark, sf_dir)).withColumn("projects", F.pmod(F.hash("project_id"), F.lit(PROJECT_GROUPS)))
    inventory.write_results(given, f"{folder}/answers", "json", ["projects"])
    inventory.write_results(a.statuses(_asked(spark, sf_dir), answers(spark, sf_dir)), f"{folder}/statuses")
    told = spark.read.schema("field_id string, entity_key string, value string, from_ordinal long, project_id string").json(f"{folder}/answers").groupBy(F.lit("answers").alias("result"), F.col("project_id").alias("of")).agg(F.count("value").alias("n"))
    return told.unionByName(spark.read.parquet(f"{folder}/statuses").groupBy(F.lit("statuses").alias("result"), F.col("status").alias("of")).agg(F.count("*").alias("n")))


def src7_transaction_features(spark, sf_dir):
    feature = "named_struct('properties', map('valeurfonc', cast(floor(o_totalprice) AS string), 'datemut', o_orderstatus), 'geometry', named_struct('type', 'Point', 'coordinates', '[1, 2]'))"
    body = f"CASE o_orderkey % 3 WHEN 0 THEN to_json(named_struct('features', array({feature}))) WHEN 1 THEN to_json(named_struct('results', array({feature}, {feature}))) ELSE to_json(array({feature})) END"
    pages = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS url", f"{body} AS body")
    found = inventory.transaction_features(pages)
    return found.groupBy(F.element_at("feature.properties", "datemut").alias("mutation")).agg(F.count("*").alias("n"), F.sum(F.element_at("feature.properties", "valeurfonc").cast("long")).alias("value"))


QUERIES = {f.__name__: f for f in (
    p1_scope, j1_matched_rules, p2_prefilter, p3_excluded, p4_resolved_dirs, p11_p12_tabs_and_scope, p13_field_statuses, w4_first_answers, w5_entity_index, a12_extraction_summary, j13_filled_answers, j14_project_location,
    p14_operation_view, a28_export_status, j21_selected_files, w18_newest_history, src1_rule_files, src3_whole_texts, src5_manifests, src4_src9_chunk_files, src9_result_files, src7_transaction_features,
)}

_ANSWERS = """
an AS (SELECT 'p' || (user_id // 3) AS project_id, event_id AS document_id, event_id AS doc_ordinal, event_type AS field_id, 'e' || (user_id % 3) AS entity_key,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 17 = 0 THEN '[]' ELSE trunc(value * 100)::BIGINT::VARCHAR END AS value FROM events),
ak AS (SELECT project_id, field_id, entity_key, CASE entity_key WHEN 'e0' THEN 'global' WHEN 'e1' THEN 'person' ELSE 'company' END AS scope, document_id // 4 AS document_id FROM an)"""
_OK = "coalesce(trim(value) NOT IN ('', 'null', '[]', '{}'), false)"
_PATH = f"'/' || array_to_string([s for s in [{canonical('s')} for s in [{canonical('s')} for s in {parts('source_path')}]] if s <> ''], '/') || '/'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _holds(folder: str) -> str:
    """Whether the joined path holds a folder pattern's segments."""
    segments = " || '/' || ".join(regex(pattern(pattern(_text(x)))) for x in folder.split("/"))
    return f"regexp_matches(joined, '/' || {segments} || '/')"


def _rule(field: str, dirs: list[str], words: list[str]) -> str:
    said = " OR ".join(f"({canonical(_text(w))} <> '' AND contains(hay, {canonical(_text(w))}))" for w in words)
    return f"SELECT doc_id, {_text(field)} AS field_id FROM hy WHERE ({said}) AND ({' OR '.join(map(_holds, dirs)) or 'true'})"


_MATCH = f"""
hy AS (SELECT doc_id, filename, source_path, {canonical(stem('filename'))} || ' ' || {canonical('source_path')} AS hay, {_PATH} AS joined FROM fi),
ru AS ({' UNION ALL '.join(_rule(*r) for r in RULES)})"""
_PHRASES = "|".join(x.replace(" ", "\\s+") for x in a.KEEP_PHRASES)

SQL = {
    "p1_scope": f"""WITH {FILES}, p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(source_path, '1. Opérateur', '9. Divers') ELSE source_path END AS source_path, CASE WHEN doc_id % 3 = 0 THEN '2. AUDIT/9. Divers/annexes' END AS audit FROM fi),
      j AS (SELECT *, {_PATH} AS joined FROM p) SELECT doc_id, {_holds('*operateur*')} OR coalesce(starts_with(lower(source_path || '/'), lower(trim(audit, '/') || '/')), false) AS kept FROM j""",
    "j1_matched_rules": f"WITH {FILES}, {_MATCH} SELECT * FROM ru",
    "p2_prefilter": f"""WITH {FILES}, {_MATCH}, h AS (SELECT doc_id, count(*) AS hits FROM ru GROUP BY 1),
      r AS (SELECT doc_id, array_to_string([x for x in [CASE WHEN hits > 0 THEN 'questions:' || hits END, CASE WHEN {_holds('2. Audit/1. Opérateur/4. Bilans')} THEN 'dossier_source' END, CASE WHEN regexp_matches({canonical('filename')}, '\\bdoc 7\\d*\\b') THEN 'casier' END,
        CASE WHEN regexp_matches({canonical(f"concat_ws(' ', {stem('filename')}, source_path)")}, '(^|\\W)(?:{_PHRASES})(\\W|$)') THEN 'famille' END, CASE WHEN len([s for s in {parts('source_path')} if list_contains({a.KEEP_FOLDERS}, {canonical('s')})]) > 0 THEN 'dossier_audit' END] if x IS NOT NULL], ',') AS reasons
        FROM hy LEFT JOIN h USING (doc_id)) SELECT * FROM r WHERE reasons <> ''""",
    "p3_excluded": f"WITH {FILES} SELECT doc_id, {' OR '.join(f"contains({canonical('source_path')}, {canonical(_text(x))})" for x in ('lumiere', 'annexes', 'x - old'))} AS excluded FROM fi",
    "p4_resolved_dirs": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'Audit ' || (o_custkey % 4) END AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'RH' ELSE 'Kbis' END AS x FROM orders)
      SELECT o_orderkey, CASE WHEN c IS NOT NULL THEN c || '/RH|' ELSE '' END || '2. Audit/*Opérateur/' || x || CASE WHEN c = 'Audit 1' THEN '' ELSE '|Audit 1/RH' END || '|a/*' AS dirs, CASE WHEN x = 'Kbis' THEN '2. Audit/*Opérateur/Kbis' ELSE '' END AS specific FROM o""",
    "p11_p12_tabs_and_scope": """WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bilan_actif_table' WHEN 1 THEN 'bilan_compte_resultat_table' WHEN 2 THEN 'bilan_societe_nom' WHEN 3 THEN 'lots_table' ELSE event_type END AS f, event_id % 5 AS s FROM events),
      t AS (SELECT event_id, s, CASE WHEN s = 0 THEN 'patrimoine' WHEN s = 1 THEN CASE f WHEN 'bilan_actif_table' THEN 'bilan' WHEN 'bilan_compte_resultat_table' THEN 'compte_resultat' ELSE 'bilan,compte_resultat' END WHEN f = 'lots_table' OR s = 2 THEN 'lots' ELSE 'operation' END AS tabs FROM e)
      SELECT event_id, tabs, CASE s WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'global' END AS scope, tabs LIKE 'bilan%' OR tabs = 'lots' AS wanted FROM t""",
    "p13_field_statuses": f"WITH {_ANSWERS}, g AS (SELECT document_id // 4 AS document_id, field_id, bool_or({_OK}) AS filled FROM an WHERE document_id % 4 > 0 GROUP BY ALL) SELECT document_id, field_id, CASE WHEN filled THEN 'rempli' ELSE 'vide' END AS status FROM (SELECT DISTINCT document_id, field_id FROM ak) LEFT JOIN g USING (document_id, field_id)",
    "w4_first_answers": f"WITH {_ANSWERS} SELECT project_id, field_id, entity_key, arg_min(value, doc_ordinal) AS value, min(doc_ordinal) AS from_ordinal FROM an WHERE {_OK} GROUP BY ALL",
    "w5_entity_index": f"WITH {_ANSWERS}, f AS (SELECT project_id, entity_key || '-' || (document_id % 7) AS entity_key, min(doc_ordinal) AS first FROM an GROUP BY ALL) SELECT project_id, entity_key, (dense_rank() OVER (PARTITION BY project_id ORDER BY first, entity_key) - 1)::INT AS k FROM f",
    "a12_extraction_summary": f"""WITH {_ANSWERS}, a AS (SELECT DISTINCT project_id, field_id, entity_key, scope FROM ak), h AS (SELECT DISTINCT project_id, field_id, entity_key, 1 AS hit FROM an WHERE document_id % 11 = 0 AND {_OK})
      SELECT project_id, {', '.join(f"count(*) FILTER (scope = '{s}') AS asked_{s}, count(*) FILTER (scope = '{s}' AND hit = 1) AS answered_{s}" for s in ('global', 'person', 'company'))}, count(DISTINCT entity_key) FILTER (scope = 'person') AS persons, count(DISTINCT entity_key) FILTER (scope = 'company') AS companies FROM a LEFT JOIN h USING (project_id, field_id, entity_key) GROUP BY 1""",
    "j13_filled_answers": f"""WITH {_ANSWERS}, g AS (SELECT document_id // 4 AS document_id, field_id, max(value) AS value FROM an GROUP BY ALL),
      n AS (SELECT document_id, field_id, 'natif' AS native FROM g WHERE document_id % 3 > 0 AND document_id % 5 > 0), h AS (SELECT CASE WHEN document_id % 2 = 0 THEN document_id + 2000000000 ELSE document_id END AS document_id, field_id, value FROM g)
      SELECT document_id, field_id, CASE WHEN {_OK} THEN value ELSE coalesce(native, value) END AS value FROM h FULL JOIN n USING (document_id, field_id)""",
    "j14_project_location": f"""WITH c AS (SELECT 'p' || (o_custkey // 10) AS project_id, o_orderkey % 50 AS document_id, o_orderkey AS ordinal, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey % 9) || ' Rue de la Paix' WHEN 1 THEN (o_custkey % 9) || ' rue de la paix 75002 Paris' WHEN 3 THEN (o_orderkey % 17) || ' avenue Foch' END AS value FROM orders WHERE o_orderkey % 5 IN (0, 1, 3)),
      r AS (SELECT *, {canonical('value')} AS key FROM c),
      p AS (SELECT a.project_id, a.key, a.ordinal, b.document_id, b.value, b.ordinal AS o FROM (SELECT project_id, key, min(ordinal) AS ordinal FROM r GROUP BY ALL) a JOIN r b ON a.project_id = b.project_id AND (contains(a.key, b.key) OR contains(b.key, a.key))),
      k AS (SELECT project_id, key, ordinal, count(DISTINCT document_id) AS documents, max(length(value)) AS size, (list(value ORDER BY length(value) DESC, o))[1] AS location FROM p GROUP BY ALL)
      SELECT project_id, location FROM k WHERE documents >= 2 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY documents DESC, size DESC, ordinal) = 1""",
    "p14_operation_view": f"""WITH v AS (SELECT 'p' || (user_id // 3) AS project_id, {[*a.SUMMARY, 'taux_emprunt', 'garantie_operation', 'autre']}[(event_id % 13)::INT + 1] AS field_id, max(CASE WHEN event_id % 4 > 0 THEN event_id::VARCHAR END) AS value FROM events GROUP BY ALL),
      f AS (SELECT * FROM v WHERE {_OK}),
      r AS (SELECT project_id, section, field_id, value, row_number() OVER (PARTITION BY project_id, section ORDER BY field_id)::INT AS place FROM (SELECT *, CASE WHEN field_id LIKE '%\\_emprunt' ESCAPE '\\' THEN 'Société emprunteuse' WHEN field_id LIKE '%\\_operation' ESCAPE '\\' THEN 'Société opération' ELSE 'Opération' END AS section FROM f))
      SELECT project_id, 'Synthèse' AS section, field_id, value, list_position({a.SUMMARY}, field_id)::INT AS place FROM f WHERE list_contains({a.SUMMARY}, field_id)
      UNION ALL SELECT project_id, section, field_id, value, place FROM r UNION ALL SELECT project_id, section, 'Montant d''une obligation', '1', place FROM r WHERE field_id = 'montant_collecte' UNION ALL SELECT project_id, section, 'Ticket Minimum', '1 000', place FROM r WHERE field_id = 'montant_collecte'""",
    "a28_export_status": """WITH e AS (SELECT 'p' || user_id AS project_id, event_type FROM events), c AS (SELECT project_id, count(*) FILTER (event_type = 'click') AS o, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type = 'purchase' AND project_id LIKE '%1%') AS s FROM e GROUP BY 1)
      SELECT project_id, o AS n_operation, f AS n_financier, s AS n_scraping, o > 0 AS operation, f > 0 AS financier, s > 0 AS scraping, o > 0 AND f > 0 AND s > 0 AS complete FROM c""",
    "j21_selected_files": f"""WITH {FILES}, f AS (SELECT project_id AS company, source_path, greatest(2018 + doc_id % 6, CASE WHEN doc_id BETWEEN 1900 AND 2199 THEN doc_id ELSE 0 END) AS year, doc_id FROM fi),
      c AS (SELECT company, min(source_path) AS chosen FROM f WHERE doc_id % 37 = 0 AND doc_id % 2 = 0 GROUP BY 1), d AS (SELECT company, source_path AS dflt FROM f QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC, source_path) = 1)
      SELECT company, coalesce(chosen, dflt) AS source_path, chosen IS NOT NULL AS is_chosen FROM d LEFT JOIN c USING (company)""",
    "w18_newest_history": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events QUALIFY place <= 25",
    "src1_rule_files": "SELECT 'f' || p_partkey AS field_id, p_name AS label, p_type AS hint FROM part WHERE p_partkey % 9 > 0",
    "src3_whole_texts": "WITH f AS (SELECT string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY source, doc_id // 4096) SELECT 'txt' AS file_type, length(text)::INT AS chars, sha256(text) AS sha FROM f",
    "src5_manifests": f"WITH {FILES} SELECT project_id, source_path || '::' || file_size_bytes AS cache_key FROM fi WHERE doc_id % 13 > 0 AND doc_id % 17 > 0",
    "src4_src9_chunk_files": "SELECT source AS project_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1",
    "src9_result_files": f"""WITH {_ANSWERS}, c AS (SELECT DISTINCT project_id, field_id, entity_key FROM an WHERE {_OK}), g AS (SELECT document_id, field_id, bool_or({_OK}) AS filled FROM an GROUP BY ALL),
      s AS (SELECT document_id, field_id, CASE WHEN filled THEN 'rempli' ELSE 'vide' END AS status FROM (SELECT DISTINCT document_id, field_id FROM ak) LEFT JOIN g USING (document_id, field_id))
      SELECT 'answers' AS result, project_id AS of, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 'statuses', status, count(*) FROM s GROUP BY ALL""",
    "src7_transaction_features": "SELECT o_orderstatus AS mutation, sum(CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS n, sum(floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS value FROM orders GROUP BY 1",
}
