"""Annual accounts: label mapping, canonical lines, metrics, checks, quality, statement comparison, registry filings."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadaster.functions import labels, numbers, text

TABLES = ["actif", "passif", "compte_resultat"]

#: For each table and canonical key, labels that stand for its total, and labels of its details, some of them
#: misspelt as well as spelt right. A label ending in ` +` also stands with `total` before it. A caller with other labels passes a dictionary table of its own.
LABELS = {
    "actif": {
        "autres_actif_residuel": (
            ["immobilisations incorporelles +", "capital souscrit non appele", "avances et acomptes verses sur commandes"],
            ["frais d establissement", "frais d etablissement", "frais de recherche et developpement", "concessions brevets licences marques procedes", "fonds commercial", "capital souscrit appele non verse"],
        ),
        "immobilisations_corporelles": (
            ["immobilisations corporelles +"],
            ["terrains", "constructions", "installations techniques materiel et outillage industriels", "installations techniques", "materiel et outillage", "materiel", "autres immobilisations corporelles", "immobilisations corporelles en cours", "avances et acomptes sur immobilisations corporelles"],
        ),
        "immobilisations_financieres": (
            ["immobilisations financieres +"],
            ["participations", "autres participations", "participations evaluees par mise en equivalence", "creances rattachees a des participations", "autres titres immobilises", "prets", "autres immobilisations financieres"],
        ),
        "stocks": (["stocks", "stocks et en cours +"], ["matieres premieres et autres approvisionnements", "matieres premieres", "en cours de production", "en cours de production de biens", "en cours de production de services", "produits intermediaires et finis", "marchandises"]),
        "creances": (["creances +"], []),
        "creances_clients": (["creances clients", "clients et comptes rattaches", "clients"], []),
        "autres_creances": (
            ["autres creances"],
            ["personnel", "etat et autres collectivites publiques", "securite sociale et autres organismes sociaux", "impots sur les benefices", "taxe sur la valeur ajoutee", "autres creances diverses", "fournisseurs debiteurs avances et acomptes"],
        ),
        "tresorerie": (["tresorerie"], []),
        "disponibilites": (["disponibilites"], []),
        "vmp": (["valeurs mobilieres de placement", "vmp"], []),
        "charges_constatees_avance": (["charges constatees d avance"], []),
        "total_actif": (["total actif", "total general actif", "total general"], []),
    },
    "passif": {
        "capital_social": (["capital social", "capital individuel", "capital"], []),
        "capitaux_propres_detail": (
            [],
            ["primes d emission", "primes d apport", "primes de fusion scission", "ecarts de revaluation", "ecarts de reevaluation", "reserve legale", "reserves statutaires et contractuelles", "reserves reglementees", "autres reserves", "reserves", "report a nouveau", "subventions d investissement", "provisions reglementees"],
        ),
        "resultat_exercice": (["resultat de l exercice", "resultat de exercice", "resultat exercice", "benefice", "perte", "resultat", "resultat net"], []),
        "capitaux_propres": (["capitaux propres +"], []),
        "provisions_pour_risques": (["provisions pour risques", "provisions +", "provisions pour risques et charges"], []),
        "provisions_pour_charges": (["provisions pour charges"], []),
        "dettes_bancaires": (["emprunts et dettes aupres des etablissements de credit", "emprunts bancaires", "dettes bancaires", "emprunts aupres des etablissements de credit"], []),
        "autres_dettes_financieres": (
            ["comptes courants d associes", "comptes courants associes", "comptes courants", "cca", "autres dettes financieres", "emprunts et dettes financieres divers", "emprunts et dettes financieres diverses"],
            ["emprunts obligataires convertibles", "emprunts obligataires", "autres emprunts obligataires"],
        ),
        "dettes_financieres": (["dettes financieres +"], []),
        "fournisseurs": (["fournisseurs", "fournisseurs et comptes rattaches", "dettes fournisseurs"], []),
        "dettes_fiscales_sociales": (["dettes fiscales et sociales", "dettes fiscales sociales"], ["dettes sociales", "dettes fiscales"]),
        "dettes_exploitation": (["dettes exploitation", "total dettes d exploitation"], []),
        "autres_passif_residuel": (["dettes sur immobilisations", "dettes sur immobilisations et comptes rattaches"], []),
        "dettes_diverses": (["autres dettes", "dettes diverses"], []),
        "produits_constates_avance": (["produits constates d avance"], []),
        "total_passif": (["total passif", "total general passif", "total general"], []),
    },
    "compte_resultat": {
        "chiffre_affaires": (["chiffre d affaires", "chiffre d affaires net", "montant net du chiffre d affaires", "ca"], ["ventes de marchandises", "production vendue de biens", "production vendue de services", "production vendue"]),
        "production_stockee": (["production stockee"], ["production immobilisee"]),
        "subventions_exploitation": (["subventions d exploitation", "subventions d exploitation recues"], []),
        "reprises_exploitation": (
            ["reprise sur amortissements et provisions transfert de charges", "reprise sur amortissements et provisions transferts de charges", "reprise sur amortissements et provisions", "reprises sur amortissements et provisions", "reprises sur depreciations et provisions"],
            ["transferts de charges"],
        ),
        "autres_produits_exploitation": (["autres produits", "autres produits d exploitation", "autres produits exploitation"], []),
        "achats_marchandises": (["achats de marchandises", "achats marchandises"], []),
        "variation_stock_marchandises": (["variation de stock de marchandises", "variation des stocks de marchandises", "variation de stock marchandises"], []),
        "achats_matieres_premieres": (["achats de matieres et autres approvisionnements", "achats de matieres premieres", "achats de maties premieres et autres approvisionnements"], []),
        "autres_charges_externes": (["achats et approvisionnements", "autres achats et charges externes", "autres achats charges externes", "charges externes", "achats et charges externes"], []),
        "variation_stock_matieres_premieres": (["variation de stock de matieres premieres et approvisionnements", "variation des stocks de matieres premieres et approvisionnements", "variation de stock matieres premieres"], []),
        "salaires": (["salaires et traitements", "salaires", "remunerations du personnel"], []),
        "charges_sociales": (["charges sociales", "charges sociales du personnel"], []),
        "impots_taxes": (["impots taxes et versements assimiles", "impots et taxes", "impots et versements assimiles"], []),
        "dotations_amortissements": (["dotations aux amortissements sur immobilisations", "dotations aux amortissements", "dotations amortissements"], []),
        "dotations_provisions": (["dotations aux provisions", "dotations aux depreciations"], []),
        "dotations": (["dotations aux amortissements et provisions", "dotations aux amortissements depreciations et provisions", "dotations d exploitation", "dotations"], []),
        "autres_charges_exploitation": (["autres charges", "autres charges d exploitation", "autres charges exploitation"], []),
        "charges": (["charges d exploitation +", "total des charges d exploitation"], []),
        "resultat_exploitation": (["resultat d exploitation", "resultat exploitation"], []),
        "operations_en_commun": (["operations en commun"], []),
        "resultat_courant_avant_impots": (["resultat courant avant impots"], []),
        "resultat_financier": (["resultat financier"], []),
        "resultat_exceptionnel": (["resultat exceptionnel"], []),
        "impots_sur_les_societes": (["impots sur les benefices", "impots sur les societes", "is"], []),
        "participation_salaries": (["participation des salaries aux resultats", "participation des salaries aux resultats de l entreprise"], []),
        "resultat_net": (["resultat net", "benefice ou perte"], []),
    },
}
#: Labels of sections, which stand for no key.
SECTIONS = {
    "actif": ["actif immobilise +", "actif circulant +"],
    "passif": ["dettes +", "total dettes divers"],
    "compte_resultat": [
        "produits d exploitation +", "produits financiers", "charges financieres", "total des produits financiers", "total des charges financieres", "produits exceptionnels", "charges exceptionnelles",
        "total des produits exceptionnels", "total des charges exceptionnelles", "total des produits", "total des charges",
    ],
}

#: Metrics that are sums of keys; a minus sign subtracts.
COMPONENTS = {
    "creances": ["creances_clients", "autres_creances"],
    "tresorerie": ["disponibilites", "vmp"],
    "autres_actif": ["charges_constatees_avance", "autres_actif_residuel"],
    "dettes_exploitation": ["fournisseurs", "dettes_fiscales_sociales"],
    "dettes_financieres": ["dettes_bancaires", "autres_dettes_financieres"],
    "autres_passif": ["provisions_pour_risques", "provisions_pour_charges", "produits_constates_avance", "autres_passif_residuel"],
    "charges": ["achats_marchandises", "variation_stock_marchandises", "achats_matieres_premieres", "variation_stock_matieres_premieres", "autres_charges_externes"],
    "salaires_charges_sociales": ["salaires", "charges_sociales"],
    "dotations": ["dotations_amortissements", "dotations_provisions"],
    "autres_elements": ["-production_stockee", "-subventions_exploitation", "-reprises_exploitation", "-autres_produits_exploitation", "autres_charges_exploitation"],
}
#: Metrics that an answer `bilan_<metric>_<n or n1>` gives where no line does.
ANSWERED = ["immobilisations_corporelles", "immobilisations_financieres", "stocks", "capital_social", "resultat_exercice", "capitaux_propres", "dettes_diverses", "dettes_bancaires", "chiffre_affaires"]
ASSETS = ["immobilisations_corporelles", "immobilisations_financieres", "stocks", "creances_clients", "autres_creances", "disponibilites", "vmp", "charges_constatees_avance", "autres_actif_residuel"]
LIABILITIES = ["capitaux_propres", "dettes_bancaires", "autres_dettes_financieres", "fournisseurs", "dettes_fiscales_sociales", "dettes_diverses", "provisions_pour_risques", "provisions_pour_charges", "produits_constates_avance", "autres_passif_residuel"]
EXPENSES = ["achats_marchandises", "variation_stock_marchandises", "achats_matieres_premieres", "variation_stock_matieres_premieres", "autres_charges_externes", "salaires", "charges_sociales", "impots_taxes", "dotations_amortissements", "dotations_provisions", "autres_charges_exploitation"]
#: Lines that the identities of results need beside those.
RESULTS = ["resultat_financier", "operations_en_commun", "resultat_exceptionnel", "impots_sur_les_societes", "participation_salaries"]
CRITICAL = ["total_actif", "total_passif", "chiffre_affaires", "charges", "resultat_exploitation", "resultat_courant_avant_impots", "resultat_net"]
TOLERANCE = 0.05


def entries() -> list[tuple[str, int, str, str | None, bool]]:
    """(table, order, label key, canonical key, is total) of the default dictionary; the first of equal labels counts."""
    out = []
    for table, keys in LABELS.items():
        given = [(label, key, total) for key, both in keys.items() for total, labels in zip((True, False), both, strict=True) for label in labels] + [(label, None, True) for label in SECTIONS[table]]
        forms = [(form, key, total) for label, key, total in given for form in ([label[:-2], f"total {label[:-2]}"] if label.endswith(" +") else [label])]
        rows = {label.replace(" ", ""): (key, total) for label, key, total in reversed(forms)}
        out += [(table, i, label, key, total) for i, (label, (key, total)) in enumerate(reversed(rows.items()))]
    return out


MOST_WORDS = 20_000


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "table_type string, rank int, label_key string, key string, is_total boolean")


def label_key(label: Column) -> Column:
    return F.regexp_replace(text.canonical_name(F.translate(label, "'’", "  ")), " ", "")


#: Letters that a label and a dictionary entry that it contains share; shorter entries are found only as they are.
GRAM = 6


def _grams(key: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(key, F.lit(f"(?=(.{{{GRAM}}}))"), 1))


def gram_index(words: DataFrame) -> DataFrame:
    """The dictionary's entries of GRAM letters or more with a key, each under the one of its grams that fewest entries have."""
    parts = words.where(f"key IS NOT NULL AND length(label_key) >= {GRAM}").select("table_type", F.col("label_key").alias("part"), F.col("rank").alias("part_rank"), F.col("key").alias("part_key"), F.col("is_total").alias("part_total"))
    each = parts.select("table_type", "part", "part_rank", F.explode(_grams(F.col("part"))).alias("gram"))
    shared = each.groupBy("table_type", "gram").agg(F.count("*").alias("n"))
    rarest = each.join(shared, ["table_type", "gram"]).groupBy("table_type", "part_rank").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return parts.join(rarest, ["table_type", "part_rank"])


def map_labels(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Adds key and is_total by the dictionary: an equal label, else the longest one, of GRAM letters at least, that the label contains.

    A label meets the entries whose rarest gram it has: an equi-join, at any size of the dictionary. A
    dictionary of MOST_WORDS entries at most is broadcast. Labels are mapped once each, not once a line.
    """
    few = words.limit(MOST_WORDS + 1).count() <= MOST_WORDS
    marked = F.broadcast if few else lambda rows: rows
    given = lines.select("table_type", "poste").distinct().withColumn("label_key", label_key(F.col("poste")))
    exact = given.join(marked(words), ["table_type", "label_key"], "left").withColumn("exact", F.col("rank").isNotNull())
    open_ = exact.where("NOT exact").select("table_type", "poste", "label_key")
    near = open_.withColumn("gram", F.explode(_grams(F.col("label_key")))).join(marked(gram_index(words)), ["table_type", "gram"]).where(F.contains(F.col("label_key"), F.col("part")))
    best = near.groupBy("table_type", "poste").agg(F.max_by(F.struct("part_key", "part_total"), F.struct(F.length("part"), -F.col("part_rank"))).alias("m")).select("table_type", "poste", F.col("m.part_key").alias("near_key"), F.col("m.part_total").alias("near_total"))
    known = exact.join(best, ["table_type", "poste"], "left").select(
        "table_type", "poste", F.when(F.col("exact"), F.col("key")).otherwise(F.col("near_key")).alias("key"), F.when(F.col("exact"), F.col("is_total")).otherwise(F.col("near_total")).alias("is_total"))
    return lines.join(known, ["table_type", "poste"], "left")


def canonical_lines(mapped: DataFrame) -> DataFrame:
    """One line per company, table and key: the last total, else the only detail, else the sum of details; lines without a key stay as raw.

    Details of equity count as equity where no total of it is given.
    """
    keyed = mapped.where("key IS NOT NULL AND poste <> ''")
    total = F.col("is_total")
    grouped = keyed.groupBy("company", "table_type", "key").agg(
        F.max_by(F.struct("poste", "n", "n1"), F.when(total, F.col("idx"))).alias("t"), F.count_if(total).alias("totals"), F.count_if(~total).alias("details"),
        F.sum(F.when(~total, F.col("n"))).alias("sum_n"), F.sum(F.when(~total, F.col("n1"))).alias("sum_n1"), F.min("idx").alias("idx"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~total, F.struct("idx", "poste")))), lambda x: x["poste"]), " + ").alias("names"),
    )
    by_total = F.col("totals") > 0
    out = grouped.select(
        "company", "table_type", "key", "idx", F.when(by_total, F.col("t.poste")).otherwise(F.col("names")).alias("poste"),
        F.when(by_total, F.col("t.n")).otherwise(F.col("sum_n")).alias("n"), F.when(by_total, F.col("t.n1")).otherwise(F.col("sum_n1")).alias("n1"))
    whole = F.max((F.col("key") == "capitaux_propres").cast("int")).over(W.partitionBy("company", "table_type"))
    detail = F.col("key") == "capitaux_propres_detail"
    out = out.withColumn("whole", whole).where(~(detail & (F.col("whole") == 1))).withColumn("key", F.when(detail, "capitaux_propres").otherwise(F.col("key"))).drop("whole")
    raw = mapped.where("key IS NULL AND coalesce(n, n1) IS NOT NULL AND poste <> ''").select("company", "table_type", F.format_string("raw_unmatched_%s_%03d", "table_type", "idx").alias("key"), "idx", "poste", "n", "n1")
    return out.unionByName(raw)


def keyed_rows(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose `key` names a label, mapped; repeats of (key, n, n1) go; companies without any key give none."""
    given = rows.withColumn("any", F.max(F.coalesce("given_key", F.lit("")) != "").over(W.partitionBy("company", "table_type"))).where("any")
    named = given.withColumn("poste", F.coalesce(F.nullif("given_key", F.lit("")), "poste"))
    mapped = map_labels(named, words).where("key IS NOT NULL")
    return mapped.groupBy("company", "table_type", "key", "n", "n1").agg(F.min("idx").alias("idx"))


def metrics(lines: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """company, metric, n, n1: sums of components if all are there, else the line itself, else a partial sum.

    Metrics without components are their lines, else what is answered. answers: company, field_id, value.
    """
    parts = [(m, k.lstrip("-"), -1.0 if k.startswith("-") else 1.0, len(ks)) for m, ks in COMPONENTS.items() for k in ks]
    rules = F.broadcast(lines.sparkSession.createDataFrame(parts, "metric string, key string, sign double, needed int"))  # COMPONENTS' rows
    sums = lines.join(rules, "key").groupBy("company", "metric", "needed").agg(*(x for c in ("n", "n1") for x in (F.sum(F.col("sign") * F.col(c)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count"))))
    own = lines.groupBy("company", F.col("key").alias("metric")).agg(F.min_by("n", "idx").alias("n"), F.min_by("n1", "idx").alias("n1"))
    both = own.join(sums, ["company", "metric"], "full_outer")
    pick = lambda c: F.when(F.col(f"{c}_count") == F.col("needed"), F.col(f"{c}_sum")).otherwise(F.coalesce(c, f"{c}_sum")).alias(c)
    found = both.select("company", "metric", pick("n"), pick("n1"))
    if answers is None:
        return found
    name = F.regexp_extract("field_id", r"^bilan_(.+)_(n1?)$", 1)
    told = answers.withColumns({"metric": name, "period": F.regexp_extract("field_id", r"_(n1?)$", 1)}).where(F.col("metric").isin(ANSWERED))
    value = lambda p: F.max(F.when(F.col("period") == p, F.regexp_replace("value", r"[\s\u00a0]", "").try_cast("double"))).alias(f"told_{p}")
    told = told.groupBy("company", "metric").agg(value("n"), value("n1"))
    return found.join(told, ["company", "metric"], "full_outer").select("company", "metric", F.coalesce("n", "told_n").alias("n"), F.coalesce("n1", "told_n1").alias("n1"))


def by_key(lines: DataFrame) -> DataFrame:
    """company, period and one column per key that the checks need."""
    wanted = sorted({*ASSETS, *LIABILITIES, *EXPENSES, *CRITICAL, *RESULTS})
    long = lines.select("company", "key", F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("v")) for p in ("n", "n1")))).alias("x")).select("company", "key", "x.*")
    return long.groupBy("company", "period").agg(*(F.max(F.when(F.col("key") == k, F.col("v"))).alias(k) for k in wanted))


def _sum(keys: list[str]) -> Column:
    return F.when(F.coalesce(*keys).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(k, F.lit(0.0)) for k in keys)))


def checks(lines: DataFrame) -> DataFrame:
    """company, period, check, lhs, rhs of each identity that is off by more than five per cent."""
    c = F.col
    expenses = _sum(EXPENSES)
    rows = [
        ("actif", _sum(ASSETS), c("total_actif"), F.abs(c("total_actif")), (_sum(ASSETS) > 0) & (c("total_actif") != 0)),
        ("passif", _sum(LIABILITIES), c("total_passif"), F.abs(c("total_passif")), (_sum(LIABILITIES) > 0) & (c("total_passif") != 0)),
        ("exploitation", c("chiffre_affaires") - expenses, c("resultat_exploitation"), F.greatest(F.abs(c("resultat_exploitation")), F.lit(1.0)),
         (expenses > 0) & (F.abs(c("resultat_exploitation")) > 0) & (F.abs(c("chiffre_affaires") - c("charges") - c("resultat_exploitation")) / F.greatest(F.abs(c("resultat_exploitation")), F.lit(1.0)) > TOLERANCE)),
        ("charges", expenses, c("charges"), F.abs(c("charges")), (c("charges") > 0) & (expenses > 0)),
        ("courant", c("resultat_exploitation") + c("resultat_financier") + F.coalesce("operations_en_commun", F.lit(0.0)), c("resultat_courant_avant_impots"), F.greatest(F.abs(c("resultat_courant_avant_impots")), F.lit(1.0)), F.lit(True)),
        ("net", c("resultat_courant_avant_impots") + c("resultat_exceptionnel") - c("impots_sur_les_societes") - F.coalesce("participation_salaries", F.lit(0.0)), c("resultat_net"), F.greatest(F.abs(c("resultat_net")), F.lit(1.0)), F.lit(True)),
        ("croise", c("total_actif"), c("total_passif"), F.greatest(F.abs(c("total_actif")), F.abs(c("total_passif")), F.lit(1.0)), F.lit(True)),
    ]
    found = F.array(*(F.struct(F.lit(n).alias("check"), a.alias("lhs"), b.alias("rhs"), F.when(ok, F.abs(a - b) / by).alias("gap")) for n, a, b, by, ok in rows))
    return by_key(lines).select("company", "period", F.explode(found).alias("x")).select("company", "period", "x.*").where(F.col("gap") > TOLERANCE)


def quality(lines: DataFrame, failed: DataFrame) -> DataFrame:
    """company, score, errors, reasons, retry: how far a company's answers can be trusted.

    A check across both sides of the balance sheet is an error of both tables.
    """
    raw, key = F.startswith("key", F.lit("raw_unmatched_")), F.col("key")
    per = lines.groupBy("company", "table_type").agg(
        F.count_if(~raw).alias("mapped"), F.count_if(raw).alias("raw"), F.count_if(F.coalesce("n", "n1").isNotNull()).alias("filled"), F.count_if(key.isin(CRITICAL)).alias("critical"),
        F.count_if(numbers.suspicious(F.col("n")) | numbers.suspicious(F.col("n1"))).alias("suspicious"))
    said = (
        ((F.col("mapped") == 0) & (F.col("filled") > 0), "lignes chiffrées non mappées"), (F.col("raw") >= F.greatest(F.lit(2), F.col("mapped")), "trop de lignes brutes non mappées"), (F.col("suspicious") > 0, "montants suspects ou concaténés"),
    )
    place = F.array_position(F.lit(TABLES), F.col("table_type"))
    reason = F.array_compact(F.array(*(F.when(is_so, F.struct(place.alias("place"), F.lit(i).alias("i"), F.concat("table_type", F.lit(f": {words}")).alias("said"))) for i, (is_so, words) in enumerate(said))))
    points = F.least(F.col("mapped"), F.lit(8)) + 3 * F.col("critical") - 4 * F.col("raw") - 8 * F.col("suspicious")
    total = per.withColumns({"points": points, "reason": reason}).groupBy("company").agg(F.sum("points").alias("points"), F.transform(F.array_sort(F.flatten(F.collect_list("reason"))), lambda x: x["said"]).alias("told"))
    errors = failed.groupBy("company").agg(F.sum(F.when(F.col("check") == "croise", 2).otherwise(1)).alias("errors"))
    rows = total.join(errors, "company", "left").withColumn("errors", F.coalesce("errors", F.lit(0))).withColumn("score", F.col("points") - 6 * F.col("errors"))
    more = F.array_compact(F.array(F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" incohérence(s) comptable(s) détectée(s)"))), F.when(F.col("score") < 12, F.lit("score global trop faible"))))
    return rows.select("company", "score", "errors", F.array_join(F.concat("told", more), " ; ").alias("reasons"), ((F.col("score") < 12) | (F.col("errors") > 0) | (F.size("told") > 0)).alias("retry"))


#: The answers about accounts that a better set replaces.
ACCOUNT_FIELDS = ["bilan_societe_nom", "bilan_date_arrete_n", "bilan_date_arrete_n1", "bilan_actif_table", "bilan_passif_table", "bilan_compte_resultat_table"]


def better(first: DataFrame, second: DataFrame, scores: DataFrame) -> DataFrame:
    """The first set of answers (company, field, value); where the second is scored better, its answers about accounts that say something take their place.

    scores: company, first_score, second_score.
    """
    wins = scores.where("second_score > first_score").select("company")
    own = second.where(F.col("field").isin(ACCOUNT_FIELDS) & labels.meaningful(F.col("value"))).join(wins, "company", "left_semi").select("company", "field", F.col("value").alias("v2"), F.lit(True).alias("told"))
    return first.join(own, ["company", "field"], "full_outer").select("company", "field", F.when(F.coalesce("told", F.lit(False)), F.col("v2")).otherwise(F.col("value")).alias("value"))


#: The lines of the reports, each a label and its metric.
ASSET_LINES = (
    ("Immobilisations corporelles", "immobilisations_corporelles"), ("Immobilisations financières", "immobilisations_financieres"), ("Stocks", "stocks"), ("Créances", "creances"), ("Trésorerie", "tresorerie"), ("Autres éléments d'actif", "autres_actif"),
)
EQUITY_LINES = (("Capital social", "capital_social"), ("Résultat", "resultat_exercice"))
LIABILITY_LINES = (
    ("Capitaux propres", "capitaux_propres"), ("Dettes financières", "dettes_financieres"), ("Dettes d'exploitation", "dettes_exploitation"), ("Dettes diverses", "dettes_diverses"), ("Autres éléments de passif", "autres_passif"),
)
RESULT_LINES = (
    ("Chiffre d'affaires", "chiffre_affaires"), ("Charges", "charges"), ("Salaires et charges sociales", "salaires_charges_sociales"), ("Impôts et taxes", "impots_taxes"), ("Dotations aux amortissements", "dotations"), ("Autres éléments", "autres_elements"),
    ("Résultat d'exploitation", "resultat_exploitation"), ("Résultat financier", "resultat_financier"), ("Résultat exceptionnel", "resultat_exceptionnel"), ("Impôts sur les sociétés", "impots_sur_les_societes"), ("Résultat net", "resultat_net"),
)
PERIODS = ("n", "n1")


def _report(found: DataFrame, wanted: list[str], lines) -> DataFrame:
    """company, place, label, n, n1, ok_n, ok_n1: the rows that lines(metric of a period) gives: (label, value or None, check or None)."""
    wide = found.where(F.col("metric").isin(wanted)).groupBy("company").agg(*(F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in wanted for p in PERIODS))
    told = [lines(lambda m, p=p: F.col(f"{m}_{p}")) for p in PERIODS]
    or_null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    rows = [F.struct(F.lit(i).alias("place"), F.lit(x[0]).alias("label"), or_null(x[1], "double").alias("n"), or_null(y[1], "double").alias("n1"), or_null(x[2], "boolean").alias("ok_n"), or_null(y[2], "boolean").alias("ok_n1")) for i, (x, y) in enumerate(zip(*told, strict=True))]
    companies = found.select("company").distinct().join(wide, "company", "left")
    return companies.select("company", F.inline(F.array(*rows)))


def balance_report(found: DataFrame) -> DataFrame:
    """company, place, label, n, n1, ok_n, ok_n1: lines, computed totals, the source's totals, and four checks of each company's balance sheet.

    found: metrics(). Lines without a value count as nothing in totals and checks; a total that the source does not give agrees.
    """
    wanted = [m for lines in (ASSET_LINES, EQUITY_LINES, LIABILITY_LINES) for _, m in lines] + ["total_actif", "total_passif"]

    def lines(v):
        some = lambda m: F.coalesce(v(m), F.lit(0.0))
        total = lambda rows: reduce(lambda x, y: x + y, (some(m) for _, m in rows))
        same = lambda x, y: F.abs(x - y) < 0.005
        source = lambda m, rows: v(m).isNull() | same(total(rows), v(m))
        return [
            *((label, v(m), None) for label, m in ASSET_LINES), ("Total Actif", total(ASSET_LINES), None), ("Total Actif (source doc)", v("total_actif"), None),
            *((label, v(m), None) for label, m in (*EQUITY_LINES, *LIABILITY_LINES)), ("Total Passif", total(LIABILITY_LINES), None), ("Total Passif (source doc)", v("total_passif"), None),
            ("Check équilibre", None, same(total(ASSET_LINES), total(LIABILITY_LINES))), ("Check total actif source", None, source("total_actif", ASSET_LINES)), ("Check total passif source", None, source("total_passif", LIABILITY_LINES)),
            ("Check résultat", None, same(some("capitaux_propres"), total(EQUITY_LINES))),
        ]

    return _report(found, wanted, lines)


def result_report(found: DataFrame) -> DataFrame:
    """As balance_report(): the lines of the profit and loss account, and after the operating and the net result their part of sales, nothing where it cannot be told.

    found: metrics() of the profit and loss account's lines alone.
    """

    def lines(v):
        margin = lambda m: ("En % du CA", F.coalesce(F.try_divide(F.coalesce(v(m), F.lit(0.0)), v("chiffre_affaires")), F.lit(0.0)), None)
        return [row for label, m in RESULT_LINES for row in ((label, v(m), None), *([margin(m)] if m in ("resultat_exploitation", "resultat_net") else []))]

    return _report(found, [m for _, m in RESULT_LINES], lines)


ORDER = ["Chiffre d'affaires", "Autres produits d'exploitation", "Charges d'exploitation", "Charges de personnel", "Dotations aux amortissements", "Résultat d'exploitation", "Résultat financier", "Résultat exceptionnel", "Impôts sur les bénéfices", "Résultat net"]


def statement_rank(label: Column) -> Column:
    """Place of a profit and loss label in the usual order; unknown ones last."""
    known = text.without_marks(F.lower(F.trim(label)))
    at = F.array_position(F.transform(F.lit(ORDER), lambda x: text.without_marks(F.lower(x))), known)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def four_columns(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Document lines with the registry's values by label, its last ones where it has a label twice; lines that only the registry has come last. Adds place.

    Lines without a label go.
    """
    d = documents.withColumn("label", text.strip(F.col("label"))).where("label <> ''").select("company", "section", "label", "ordinal", F.col("n").alias("document_n"), F.col("n1").alias("document_n1"))
    given = registry.withColumn("label", text.strip(F.col("label"))).where("label <> ''")
    by = ["company", "section", "label"]
    last = given.groupBy(*by).agg(F.max_by(F.struct("n", "n1"), "ordinal").alias("v"))
    told = d.join(last, by, "left").select(*by, F.lit(0).alias("side"), "ordinal", "document_n", "document_n1", F.col("v.n").alias("registry_n"), F.col("v.n1").alias("registry_n1"))
    nothing = F.lit(None).cast("double")
    only = given.join(d, by, "left_anti").select(*by, F.lit(1).alias("side"), "ordinal", nothing.alias("document_n"), nothing.alias("document_n1"), F.col("n").alias("registry_n"), F.col("n1").alias("registry_n1"))
    w = W.partitionBy("company", "section").orderBy("side", "ordinal", "label")
    return told.unionByName(only).withColumn("place", F.row_number().over(w)).drop("side", "ordinal")


def with_margins(rows: DataFrame) -> DataFrame:
    """Profit and loss rows with EBITDA and margin rows after their anchors; place orders them."""
    values = ["document_n", "document_n1", "registry_n", "registry_n1"]
    of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c))).over(W.partitionBy("company"))
    rows = rows.withColumns({f"{k}_{c}": of(label, c) for k, label in (("ca", ORDER[0]), ("da", ORDER[4])) for c in values})
    base = rows.select("company", "label", F.col("place").cast("double").alias("place"), *values)
    operating, net = rows.where(F.col("label") == ORDER[5]), rows.where(F.col("label") == ORDER[9])
    ebitda = operating.select("company", F.lit("EBITDA").alias("label"), (F.col("place") + 0.25).alias("place"), *(F.when(F.coalesce(c, f"da_{c}").isNotNull(), F.coalesce(c, F.lit(0.0)) + F.coalesce(f"da_{c}", F.lit(0.0))).alias(c) for c in values))
    margin = operating.unionByName(net).select("company", F.lit("En % du CA").alias("label"), (F.col("place") + 0.5).alias("place"), *(F.try_divide(F.col(c), F.col(f"ca_{c}")).alias(c) for c in values))
    return base.unionByName(ebitda).unionByName(margin)


def group_values(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """company, label, n, n1: the sums of each group's sources, by code, else by normalised label; null if none is found.

    lines: company, code, label, n, n1. groups: label, sources; written by hand, MOST_WORDS sources at most become literals.
    """
    norm = lambda c: text.without_marks(F.lower(F.trim(c)))
    last = lambda key: lines.where(key != "").groupBy("company", key.alias("source")).agg(F.max_by(F.struct("n", "n1"), "ordinal").alias("v"))
    few = groups.limit(MOST_WORDS + 1).collect()
    if sum(len(r.sources) for r in few) <= MOST_WORDS:
        pair = F.from_json(F.lit(json.dumps([{"label": r.label, "source": x} for r in few for x in r.sources])), "array<struct<label: string, source: string>>")
        asked = lines.select("company").distinct().select("company", F.inline(pair))
    else:
        # every company has every group in the result
        asked = lines.select("company").distinct().crossJoin(groups.select("label", F.explode("sources").alias("source")))
    by_code = last(F.col("code")).withColumnRenamed("v", "by_code")
    by_label = last(norm(F.col("label"))).withColumnsRenamed({"v": "by_label", "source": "norm"})
    found = asked.withColumn("norm", norm(F.col("source"))).join(by_code, ["company", "source"], "left").join(by_label, ["company", "norm"], "left")
    v = F.coalesce("by_code", "by_label")
    return found.groupBy("company", "label").agg(F.sum(v["n"]).alias("n"), F.sum(v["n1"]).alias("n1"))


def pick_year(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """The registry year for each document: one, two or three before its own, else the latest.

    documents: document_id, company, year. filings: company, year.
    """
    both = documents.join(filings.select("company", F.col("year").alias("filed")).distinct(), "company")
    back = F.col("year") - F.col("filed")
    order = F.struct(F.when(back.between(1, 3), back).otherwise(9), -F.col("filed"))
    return both.groupBy("document_id").agg(F.min_by("filed", order).alias("registry_year"))


#: The columns that may hold a line's amount, by side.
AMOUNT_COLUMNS = {
    "actif": ["Net année N", "Total année N", "Montant année N"],
    "passif": ["Montant année N", "Total année N", "Net année N"],
    "compte_resultat": ["Total année N", "Montant année N", "Net année N"],
    "annexe": ["Montant année N", "Montant fin d’exercice", "Montant fin d'exercice", "Net année N", "Total année N", "Montant brut"],
}
FILING = "map<string, array<struct<date_cloture: string, sections: array<struct<libelle: string, liasses: array<struct<code: string, libelle: string, colonnes: array<struct<libelle: string, valeur: double>>>>>>>>>"


def statement_side(section: Column, code: Column) -> Column:
    name, number = text.canonical_name(section), code.try_cast("int")
    has = lambda w: F.contains(name, F.lit(w))
    return (
        F.when(has("compte de resultat"), "compte_resultat").when(has("actif") & ~has("passif"), "actif").when(has("passif") & ~has("actif"), "passif")
        .when(has("bilan"), F.when(number < 120, "actif").when(number <= 180, "passif").otherwise("annexe")).otherwise("annexe")
    )


def primary_value(side: Column, columns: Column, suffix: str = "") -> Column:
    """The amount of the first column that is there, even if it is null, in the side's order."""
    out = F.lit(None).cast("double")
    for name, labels in AMOUNT_COLUMNS.items():
        # a later label is tested first: an earlier one stands outermost
        own = reduce(lambda rest, label: F.when(F.map_contains_key(columns, label), F.try_element_at(columns, F.lit(label))).otherwise(rest), [f"{x}{suffix}" for x in reversed(labels)], F.lit(None).cast("double"))
        out = F.when(side == name, own).otherwise(out)
    return out


#: A payload that is flat already: entries of a year, lines of a side.
FLAT = "struct<entries: array<struct<y: string, lines: array<struct<section: int, side: string, code: string, label: string, n: double, n1: double>>>>>"


def flat_filings(filings: DataFrame) -> DataFrame:
    """The lines of payloads that are flat already, as flatten_filings() has them."""
    rows = filings.select("siren", F.posexplode(F.from_json("payload", FLAT)["entries"]).alias("entry", "e"))
    rows = rows.select("siren", F.col("e.y").alias("year"), "entry", F.posexplode("e.lines").alias("line_index", "l"))
    return rows.select("siren", "year", "entry", F.coalesce("l.section", F.lit(0)).alias("section_index"), "line_index", "l.side", "l.code", "l.label", "l.n", "l.n1")


def flatten_filings(filings: DataFrame) -> DataFrame:
    """One row per line of each filing (siren, payload): year, side, code, label, n, n1; payloads with `entries` are flat already."""
    is_flat = F.coalesce(F.get_json_object("payload", "$.entries").isNotNull(), F.lit(False))
    nested, filings = filings.where(~is_flat), filings.where(is_flat)
    return _flatten(nested).unionByName(flat_filings(filings))


def _flatten(filings: DataFrame) -> DataFrame:
    rows = filings.select("siren", F.explode(F.from_json("payload", FILING)).alias("year", "entries")).select("siren", "year", F.posexplode_outer("entries").alias("entry", "e"))
    rows = rows.select("siren", "year", "entry", F.posexplode_outer("e.sections").alias("section_index", "s")).select("siren", "year", "entry", "section_index", F.col("s.libelle").alias("section"), F.posexplode_outer("s.liasses").alias("line_index", "l"))
    columns = F.map_from_entries(F.transform(F.col("l.colonnes"), lambda c: F.struct(F.coalesce(c["libelle"], F.lit("")), c["valeur"])))
    rows = rows.withColumns({"columns": columns, "side": statement_side(F.coalesce("section", F.lit("")), F.col("l.code"))})
    return rows.select("siren", "year", "entry", "section_index", "line_index", "side", F.col("l.code").alias("code"), F.col("l.libelle").alias("label"), primary_value(F.col("side"), F.col("columns")).alias("n"), primary_value(F.col("side"), F.col("columns"), "-1").alias("n1"))


def of_latest_year(files: DataFrame) -> DataFrame:
    """Of each company folder the files of its latest year, `last`, and those without a year; files: company_folder, year."""
    last = files.groupBy("company_folder").agg(F.max("year").alias("last"))
    return files.join(last, "company_folder").where("year IS NULL OR year >= last")


def company_periods(files: DataFrame) -> DataFrame:
    """company_folder, place, period, files (array of year, name, source_path), of each company's files by year; newest periods and files first.

    files: company_folder, year or null, filename, source_path. Files without a year are a period of their own, with those that come after it by name.
    """
    period = F.when(F.col("year").isNotNull(), F.concat(F.lit("Bilan "), F.col("year").cast("string"))).otherwise("Autres bilans")
    listed = F.sort_array(F.collect_list(F.struct(F.coalesce("year", F.lit(0)).alias("year"), F.col("filename").alias("name"), "source_path")), asc=False)
    per = files.withColumn("period", period).groupBy("company_folder", "period").agg(listed.alias("files"))
    return per.withColumn("place", F.row_number().over(W.partitionBy("company_folder").orderBy(F.desc("period"))))


def latest_documents(files: DataFrame) -> DataFrame:
    """Of each company folder the file of the latest year, else the latest modified."""
    w = W.partitionBy("company_folder").orderBy(F.desc_nulls_last("year"), F.desc("modified_at"), "source_path")
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
