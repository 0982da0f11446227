"""Question rules and answers: file scope and prefilter, rule matching, consolidation, statuses, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import labels, text
from cadaster.operators import matching

#: Phrases in names that keep a file, and folders whose files are kept.
KEEP_PHRASES = [
    "kbis", "contrat obligataire", "contrat", "garantie", "hypotheque", "promesse de vente", "bilan", "comptes annuels", "liasse fiscale", "etats financiers", "ef", "attestation patrimoniale", "fiche patrimoniale",
    "patrimoniale", "casier judiciaire", "extrait de casier", "avis d impot", "track record", "lots", "grille de lots", "grille lots", "commercialisation", "offre", "grille de prix",
]
KEEP_FOLDERS = ["acquisition", "garanties", "rh", "elements techniques", "elements financiers", "commercialisation"]
GENERIC_FOLDERS = ["audit", "operateur", "rh", "ressources humaines", "elements juridiques", "elements financiers"]
MOST_RULES = 1_000
SUMMARY = ["raison_sociale_operation", "siren_operation", "dirigeants_operation", "raison_sociale_emprunt", "siren_emprunt", "dirigeants_emprunt", "localisation_projet", "montant_collecte", "duree", "ltv"]


def in_scope(path: Column, audit_folder: Column) -> Column:
    """Whether a file lies under the operator's folder or the chosen audit folder."""
    under = lambda folder: F.startswith(F.lower(F.concat(path, F.lit("/"))), F.lower(F.concat(F.trim(folder, F.lit("/")), F.lit("/"))))
    return F.coalesce(text.path_has_segments(path, F.lit("*operateur*")), F.lit(False)) | F.coalesce((audit_folder != "") & under(audit_folder), F.lit(False))


def resolve_dirs(dirs: Column, audit_folder: Column) -> Column:
    """Rule folders with the chosen audit folder filled in, distinct in order; those that need one go where none is chosen."""
    mark = F.lit("{selected_audit_folder}")
    known = F.filter(dirs, lambda d: ~F.contains(d, mark) | (F.coalesce(audit_folder, F.lit("")) != ""))
    return F.array_distinct(F.transform(known, lambda d: F.replace(d, mark, F.coalesce(audit_folder, F.lit("")))))


def is_specific(pattern: Column) -> Column:
    """Three named segments at least, the last being no generic folder."""
    named = F.filter(F.transform(F.split(F.replace(pattern, F.lit("*"), F.lit("")), "/"), text.canonical_name), lambda s: s != "")
    return (F.size(named) >= 3) & ~F.coalesce(F.element_at(F.array_append(named, F.lit("audit")), F.greatest(F.size(named), F.lit(1))).isin(GENERIC_FOLDERS), F.lit(False))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern is loosely in the path; patterns: a list of words."""
    known = [text.canonical_name(F.lit(p)) for p in patterns]  # literals, folded when the plan is made
    return text.let(text.canonical_name(path), lambda name: reduce(lambda x, y: x | y, ((p != "") & F.contains(name, p) for p in known), F.lit(False)))


def match_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a file and a rule: the path holds one of the rule's folders, if it has any, and a keyword occurs in name or path.

    Rules are the hand-written configuration: up to MOST_RULES they become literals of one
    expression over a file's row, so that nothing is joined; more of them meet names and paths in a join. Empty keywords match nothing.
    """
    given = rules.select("field_id", "source_dirs", "hint_keywords").limit(MOST_RULES + 1).collect()
    any_of = lambda conditions: reduce(lambda x, y: x | y, conditions, F.lit(False))
    hay = F.concat_ws(" ", text.canonical_stem(F.col("filename")), text.canonical_name(F.col("source_path")))
    rows = text.once(files, "__of", F.struct(hay.alias("hay"), text.joined_segments(F.col("source_path")).alias("path")))
    if len(given) > MOST_RULES:
        return _many_rules(rows, rules).drop("__of")

    def fits(rule):
        words = [text.canonical_name(F.lit(k)) for k in rule.hint_keywords or []]
        inside = any_of(text.holds_segments(F.col("__of.path"), F.lit(d)) for d in rule.source_dirs) if rule.source_dirs else F.lit(True)
        return any_of((k != "") & F.contains(F.col("__of.hay"), k) for k in words) & inside

    found = F.array_compact(F.array(*(F.when(fits(r), F.lit(r.field_id)) for r in given), F.lit(None).cast("string")))
    return rows.withColumn("field_id", F.explode(found)).drop("__of")


def _many_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """match_rules() for any number of rules: keywords meet the texts that hold them by their rarest letters."""
    words = rules.select("field_id", "source_dirs", F.explode("hint_keywords").alias("word")).withColumn("key", text.canonical_name(F.col("word"))).where("key <> ''")
    hays = rows.select(F.col("__of.hay").alias("key")).distinct()
    found = matching.containment(words.select("key").distinct(), hays, []).toDF("key", "hay")
    own = found.join(words.select("key", "field_id", "source_dirs").distinct(), "key").select("hay", "field_id", "source_dirs").distinct()
    both = rows.join(own, F.col("__of.hay") == F.col("hay"))
    inside = (F.size(F.coalesce("source_dirs", F.expr("cast(array() AS array<string>)"))) == 0) | F.exists("source_dirs", lambda d: text.holds_segments(F.col("__of.path"), d))
    return both.where(inside).drop("hay", "source_dirs").distinct()


def keep_reasons(path: Column, filename: Column, rule_hits: Column, specific_dirs: Column, is_record: Column) -> Column:
    """Why a file is worth extracting; none means it is left out."""
    phrases = "|".join(p.replace(" ", r"\s+") for p in KEEP_PHRASES)
    phrase = F.rlike(text.canonical_name(F.concat_ws(" ", text.stem(filename), path)), F.lit(rf"(?<!\w)(?:{phrases})(?!\w)"))
    folder = F.exists(text.canonical_segments(path), lambda s: s.isin(KEEP_FOLDERS))
    return F.array_compact(F.array(
        F.when(rule_hits > 0, F.concat(F.lit("questions:"), rule_hits.cast("string"))), F.when(F.exists(specific_dirs, lambda d: text.path_has_segments(path, d)), "dossier_source"),
        F.when(is_record, "casier"), F.when(phrase, "famille"), F.when(folder, "dossier_audit")))


BALANCE, RESULT, SHARED, LOTS = ["bilan_actif_table", "bilan_passif_table"], ["bilan_compte_resultat_table"], ["bilan_societe_nom", "bilan_date_arrete_n"], ["lots_table"]


def tabs(field_id: Column, sheet: Column) -> Column:
    """The report tabs that a field feeds."""
    both = F.lit(["bilan", "compte_resultat"])
    company = F.when(field_id.isin(SHARED), both).when(field_id.isin(BALANCE), F.lit(["bilan"])).when(field_id.isin(RESULT), F.lit(["compte_resultat"])).otherwise(both)
    return F.when(sheet == "{person_name}", F.lit(["patrimoine"])).when(sheet == "{company_name}", company).when(field_id.isin(LOTS) | (sheet == "Commercialisation"), F.lit(["lots"])).otherwise(F.lit(["operation"]))


def scope(sheet: Column) -> Column:
    return F.when(sheet == "{person_name}", "person").when(sheet == "{company_name}", "company").otherwise("global")


def statuses(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """document_id, field_id, status of every distinct question put to a document."""
    given = answers.groupBy("document_id", "field_id").agg(F.bool_or(labels.meaningful(F.col("value"))).alias("filled"))
    rows = asked.select("document_id", "field_id").distinct().join(given, ["document_id", "field_id"], "left")
    return rows.select("document_id", "field_id", F.when(F.col("filled"), "rempli").otherwise("vide").alias("status"))


def consolidate(answers: DataFrame) -> DataFrame:
    """The first meaningful answer of each project, field and entity, in document order."""
    return answers.where(labels.meaningful(F.col("value"))).groupBy("project_id", "field_id", "entity_key").agg(F.min_by("value", "doc_ordinal").alias("value"), F.min("doc_ordinal").alias("from_ordinal"))


def entity_index(answers: DataFrame) -> DataFrame:
    """A dense number for each entity of a project, by first appearance."""
    first = answers.groupBy("project_id", "entity_key").agg(F.min("doc_ordinal").alias("first"))
    return first.select("project_id", "entity_key", (F.dense_rank().over(W.partitionBy("project_id").orderBy("first", "entity_key")) - 1).alias("k"))


def fill_missing(answers: DataFrame, native: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers with natively extracted values where a requested one says nothing."""
    n = native.join(asked.select("document_id", "field_id").distinct(), ["document_id", "field_id"], "left_semi").withColumnRenamed("value", "native")
    both = answers.join(n, ["document_id", "field_id"], "full_outer")
    return both.select("document_id", "field_id", F.when(labels.meaningful(F.col("value")), F.col("value")).otherwise(F.coalesce("native", "value")).alias("value"))


def project_location(candidates: DataFrame) -> DataFrame:
    """project_id, location: of the addresses that two documents at least agree on, the best-supported one's longest form.

    candidates: project_id, document_id, ordinal, value. Addresses agree if one contains the other: distinct ones of a
    project meet on the rarest letters of the one that is contained.
    """
    rows = candidates.where(labels.is_precise_address(F.col("value"))).withColumn("key", text.canonical_name(F.col("value"))).where("key <> ''")
    keys = rows.groupBy("project_id", "key").agg(F.collect_set("document_id").alias("documents"), F.max_by(F.trim("value"), F.struct(F.length(F.trim("value")), -F.col("ordinal"))).alias("longest"), F.max(F.length("value")).alias("size"), F.min("ordinal").alias("ordinal"))
    inside = matching.containment(keys, keys, ["project_id"])
    agreeing = inside.union(inside.where("a <> b").select("project_id", "b", "a")).toDF("project_id", "key", "o_key")
    other = keys.select("project_id", F.col("key").alias("o_key"), F.col("documents").alias("o_documents"), F.col("longest").alias("o_longest"), F.col("size").alias("o_size"), F.col("ordinal").alias("o_ordinal"))
    pairs = agreeing.join(other.hint("merge"), ["project_id", "o_key"]).join(keys.select("project_id", "key", "ordinal").hint("merge"), ["project_id", "key"])
    clusters = pairs.groupBy("project_id", "key", "ordinal").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("o_documents")))).alias("documents"), F.max("o_size").alias("size"), F.max_by("o_longest", F.struct("o_size", -F.col("o_ordinal"))).alias("location"))
    return clusters.where("documents >= 2").groupBy("project_id").agg(F.max_by("location", F.struct("documents", "size", -F.col("ordinal"))).alias("location"))


def extraction_summary(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions asked and answered by scope, people and companies of each project."""
    a = asked.select("project_id", "field_id", "entity_key", "scope").distinct()
    rows = a.join(consolidate(answers).select("project_id", "field_id", "entity_key", F.lit(1).alias("hit")), ["project_id", "field_id", "entity_key"], "left")
    counts = [f for s in ("global", "person", "company") for f in (F.count_if(F.col("scope") == s).alias(f"asked_{s}"), F.count_if((F.col("scope") == s) & F.col("hit").isNotNull()).alias(f"answered_{s}"))]
    return rows.groupBy("project_id").agg(*counts, *(F.count_distinct(F.when(F.col("scope") == s, F.col("entity_key"))).alias(n) for s, n in (("person", "persons"), ("company", "companies"))))


#: Rows that follow a field of the operation tab.
FIXED_ROWS = {"montant_collecte": [("Montant d'une obligation", "1"), ("Ticket Minimum", "1 000")]}


def operation_view(values: DataFrame) -> DataFrame:
    """Filled fields of a project's operation tab: summary cards in their order, then sections by what the id ends with.

    After the fields that have fixed rows these follow, at the field's place, with their own values.
    """
    filled = values.where(labels.meaningful(F.col("value")))
    card = F.array_position(F.lit(SUMMARY), F.col("field_id"))
    section = F.when(F.endswith("field_id", F.lit("_emprunt")), "Société emprunteuse").when(F.endswith("field_id", F.lit("_operation")), "Société opération").otherwise("Opération")
    cards = filled.where(card > 0).select("project_id", F.lit("Synthèse").alias("section"), "field_id", "value", card.cast("int").alias("place"))
    w = W.partitionBy("project_id", "section").orderBy("field_id")
    rest = filled.withColumn("section", section).select("project_id", "section", "field_id", "value", F.row_number().over(w).alias("place"))
    entry = lambda label, value: F.struct(F.lit(label).alias("field_id"), F.lit(value).alias("value"))
    after = reduce(lambda c, k: c.when(F.col("of") == k, F.array(*(entry(*x) for x in FIXED_ROWS[k]))), FIXED_ROWS, F)
    fixed = rest.withColumnRenamed("field_id", "of").drop("value").select("project_id", "section", F.inline(after), "place")
    return cards.unionByName(rest).unionByName(fixed)


def export_status(projects: DataFrame, **tables: DataFrame) -> DataFrame:
    """For each project and table whether it has rows, and how many."""
    out = projects
    for name, t in tables.items():
        out = out.join(t.groupBy("project_id").agg(F.count("*").alias(f"n_{name}")), "project_id", "left")
    counts = [F.coalesce(f"n_{n}", F.lit(0)) for n in tables]
    return out.select("project_id", *(c.alias(f"n_{n}") for n, c in zip(tables, counts, strict=True)), *((c > 0).alias(n) for n, c in zip(tables, counts, strict=True)), reduce(lambda x, y: x & y, (c > 0 for c in counts)).alias("complete"))


def with_default_selection(files: DataFrame, selected: DataFrame) -> DataFrame:
    """The file selected for each company, if it is still there, else the latest period's first."""
    valid = selected.join(files.select("company", "source_path"), ["company", "source_path"], "left_semi").groupBy("company").agg(F.min("source_path").alias("chosen"))
    default = files.groupBy("company").agg(F.min_by("source_path", F.struct((-F.coalesce("year", F.lit(0))).alias("y"), "source_path")).alias("default"))
    return default.join(valid, "company", "left").select("company", F.coalesce("chosen", "default").alias("source_path"), F.col("chosen").isNotNull().alias("is_chosen"))


def newest(history: DataFrame, keys: list[str], keep: int = 25) -> DataFrame:
    return history.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("place") <= keep)
