"""Literal cases, with the results that the descriptions give, for accounts, grids, sections, companies, prices and ingest."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadaster.functions import numbers, text
from cadaster.operators import accounts, answers, comparables, companies, corpus, grids, incremental, matching
from cadaster.streaming import ingest

NB, NNB = " ", " "


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


# --- no-break blanks ---------------------------------------------------------------------------------


def test_no_break_blanks_are_blanks(spark):
    said = {"a": f"bilan{NB}2020", "b": f"{NB}1.{NB}Opérateur", "c": f"Bilan{NNB}été"}
    r = one(spark, **{k: text.canonical_name(F.lit(v)) for k, v in said.items()})
    assert (r.a, r.b, r.c) == ("bilan", "operateur", "bilan ete")
    r = one(
        spark, price=numbers.priced(F.lit(f"1{NB}234,50 €")), thin=numbers.priced(F.lit(f"1{NNB}234,50{NB}€")), street=text.street_key(F.lit(f"12{NB}rue{NB}de la{NNB}Paix")), address=text.address_key(F.lit(f"12{NB}rue")),
        slug=text.slug(F.lit(f"Société{NB}Est")), pattern=text.canonical_pattern(F.lit(f"{NB}*Opérateur")), cell=numbers.statement_amount(F.lit(f"({NB}1{NNB}234,5)")), word=numbers.statement_amount(F.lit("12 €")), odd=numbers.statement_amount(F.lit("12d")),
    )
    assert (r.price, r.thin, r.street, r.address, r.slug, r.pattern) == (1234.5, 1234.5, "paix", "12 rue", "societe-est", "*operateur")
    assert (r.cell, r.word, r.odd) == (None, None, None)
    assert one(spark, x=numbers.statement_amount(F.lit(f"(1{NNB}234,5)"))).x == -1234.5


def test_price_pages_with_no_break_blanks(spark):
    pages = [
        ("a", "Lyon", [f"Prix moyen du terrain constructible en France :{NB}120{NB}€/m²", f"Calculé sur 1{NNB}250 terrains à vendre"]), ("b", "Lyon", ["LYON (69000)", "x", f"1{NB}234 €/m²"]),
        ("c", "Lyon", ["Prix moyen du terrain constructible dans le 69 :", "98,5 € / m2"]), ("d", "Lyon", ["Lyon", "a", "b", "c", "99 €/m²"]), ("e", "Lyon", ["Prix moyen du terrain constructible ailleurs : 5 €/m²"]),
    ]
    got = {r.url: (r.price, r.sample) for r in grids.land_prices(spark.createDataFrame(pages, "url string, city string, lines array<string>")).collect()}
    assert got == {"a": (120.0, 1250), "b": (1234.0, None), "c": (98.5, None), "d": (None, None), "e": (None, None)}
    h = lambda page: one(spark, h=grids.harvest(F.lit(page), F.lit(100))).h
    assert h(f"environ 3{NB}456 € /{NB}m²").m2 == 3456 and h(f"Prix au m2 : 4{NNB}100 €").m2 == 4100 and h("prix au m² ** 120 €").m2 is None
    assert (h("fourchette basse 200 000 € moyenne de 300 000 € haute 400 000 €").low, h("moyenne de 300 000 €").m2, h("haut : 400 000 €").high) == (2000, 3000, 4000)


def test_distress_over_a_line_end(spark):
    rows = [("1", 0, "Avis de liquidation\njudiciaire"), ("2", 0, f"Liquidation{NB}judiciaire prononcée. Suite."), ("3", 0, "Rien."), ("4", 0, "Jugement d'ouverture de redressement judiciaire. Liquidation\njudiciaire")]
    got = {r.siren: (r.sentence, r.matched) for r in companies.distress_signal(spark.createDataFrame(rows, "siren string, ordinal int, contenu string")).collect()}
    assert got == {"1": ("Avis de liquidation judiciaire", 1), "2": ("Liquidation judiciaire prononcée.", 1), "4": ("Jugement d'ouverture de redressement judiciaire.", 1)}


# --- sections and grids ------------------------------------------------------------------------------


def sections(spark, *texts):
    return spark.createDataFrame([("d", i, f"T{i}", t) for i, t in enumerate(texts)], "document_id string, section long, title string, text string")


def test_a_long_line_is_cut(spark):
    words = " ".join(f"mot{i}" for i in range(4000))
    parts = corpus.split_oversize(sections(spark, words, "x" * 20_000, "court"), 300, 40).orderBy("section", "part").collect()
    own = [r for r in parts if r.section == 0]
    assert all(len(r.text) <= 1200 for r in parts) and [r.title for r in own[:2]] == ["T0 (Part 1)", "T0 (Part 2)"] and own[0].section_type == "section_split"
    seen = [r.text.split(" ") for r in own]
    at = 0
    for before, after in zip(seen, seen[1:], strict=False):
        again = before.index(after[0])
        assert before[again:] == after[: len(before) - again] and 0 < len(" ".join(before[again:])) <= 4 * 40
        at += again
    assert seen[0][0] == "mot0" and seen[-1][-1] == "mot3999" and at > 0
    plain = [r.text for r in parts if r.section == 1]
    assert {len(t) for t in plain[:-1]} == {1200} and sum(len(t) for t in plain) - 160 * (len(plain) - 1) == 20_000
    assert [(r.part, r.section_type, r.title) for r in parts if r.section == 2] == [(0, "section", "T2")]


def test_parts_end_at_the_coarsest_separator(spark):
    long_ = "a b. " * 100
    (big,) = [[r.text for r in corpus.split_oversize(sections(spark, f"un\n\ndeux\n\n{long_}\n\ntrois"), 50, 5).orderBy("part").collect()]]
    assert big[0] == "un\n\ndeux" and big[-1] == "trois" and all(len(t) <= 200 for t in big) and all(t.startswith((".", "a")) for t in big[1:-1])


def grid(spark, *rows):
    return grids.logical_rows(spark.createDataFrame([(1, [["Poste", "2021", "2020"], *map(list, rows)])], "doc_id long, cells array<array<string>>")).orderBy("pos").collect()


def test_logical_rows(spark):
    got = grid(
        spark, ("Capitaux propres", "", ""), ("Emprunts", "", ""), ("dont concours bancaires", "5", "4"), ("du 01/01/2020 au 31/12/2020", "", ""), ("", "7", ""), ("Dettes", "", ""), ("- à vue", "", ""), ("", "8", "9"),
        ("Brut Amort Net", "", ""), ("Stocks ,", "1 000,50", "(2)"), ("Stocks ,", "1 000,50", "(2)"), ("Seul", "", ""), ("Autre", "3", ""), ("A", None, ""), ("B", "", ""), ("C", "", ""), ("D", "", ""), ("", "1", "1"), ("BILAN ACTIF", "", ""), ("", "2", "2"),
    )
    assert [(r.label, r.n, r.n1, r.rebuilt) for r in got] == [
        ("Poste", 2021.0, 2020.0, False), ("Emprunts dont concours bancaires", 5.0, 4.0, True), ("Dettes - à vue", 8.0, 9.0, True), ("Stocks,", 1000.5, -2.0, False), ("Autre", 3.0, None, False), ("B C D", 1.0, 1.0, True),
    ]


def test_logical_rows_of_odd_grids(spark):
    rows = [(1, []), (2, None), (3, [["Total"]]), (4, [["x", "1"], ["Seul", "2"]])]
    got = [(r.doc_id, r.label, r.n, r.n1) for r in grids.logical_rows(spark.createDataFrame(rows, "doc_id long, cells array<array<string>>")).collect()]
    assert sorted(got) == [(4, "Seul", 2.0, 2.0), (4, "x", 1.0, 1.0)]


def test_value_columns_stay_inside_the_grid(spark):
    rows = [(1, [["a"], ["b"]]), (2, [["a", "b"], ["c", "d"]]), (3, [["a", "b", "c"], ["d", "e", "f"]]), (4, [["a", "b", "c"], ["d", "1", "f"]])]
    got = {r.doc_id: (r.first, r.second) for r in grids.value_columns(spark.createDataFrame(rows, "doc_id long, cells array<array<string>>")).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 2), 4: (1, 1)}


def test_section_scores_and_spans(spark):
    figures = [f"Ligne {i} 1 234" for i in range(18)]
    pages = [
        (1, 1, ["Bilan actif"]), (1, 2, ["Actif circulant", *figures]), (1, 3, ["rien"]), (1, 4, ["Actif immobilisé"]), (2, 1, ["Bilan actif"]), (2, 2, ["Notes sur le bilan", "actif immobilisé", "actif circulant"]),
        (3, 1, ["Bilan actif"]), (3, 2, ["page"]), (3, 3, ["Bilan passif"]), (3, 4, ["Capital social"]),
    ]
    tables = [(3, 2, 0, [["Créances", "12"]] * 9), (3, 2, 1, [["x", "y"]] * 40), (2, 2, 0, [["Créances", "1"]])]
    p = spark.createDataFrame(pages, "doc_id long, page int, lines array<string>")
    t = spark.createDataFrame(tables, "doc_id long, page int, table_idx int, cells array<array<string>>")
    score = {(r.doc_id, r.page): r.score for r in grids.section_scores(p.withColumn("section", F.lit("bilan_actif")), t).collect()}
    assert score[1, 2] == 4 and score[1, 3] == 0 and score[1, 4] == 2 and score[2, 2] == -10 and score[3, 2] == 5
    spans = lambda n: {(r.doc_id, r.section): (r.page, r.end_page) for r in grids.page_spans(p, t, n).collect()}
    assert spans(3) == {(1, "bilan_actif"): (1, 2), (2, "bilan_actif"): (1, 1), (3, "bilan_actif"): (1, 2), (3, "bilan_passif"): (3, 4)}
    assert spans(1)[3, "bilan_actif"] == (1, 2)


# --- accounts ----------------------------------------------------------------------------------------

LINES = "company string, table_type string, key string, idx int, poste string, n double, n1 double"


def lines(spark, **values):
    side = lambda k: "actif" if k in (*accounts.ASSETS, "total_actif") else "passif" if k in (*accounts.LIABILITIES, "total_passif") else "compte_resultat"
    return spark.createDataFrame([("c", side(k), k, i, k, float(v), None) for i, (k, v) in enumerate(values.items())], LINES)


@pytest.mark.parametrize(
    "values",
    [
        {"resultat_courant_avant_impots": 1000, "resultat_exceptionnel": 0, "impots_sur_les_societes": 200, "participation_salaries": 100, "resultat_net": 700},
        {"resultat_exploitation": 500, "resultat_financier": 0, "operations_en_commun": 100, "resultat_courant_avant_impots": 600},
        {"capitaux_propres": 500, "provisions_pour_charges": 300, "autres_passif_residuel": 200, "total_passif": 1000},
        {k: 10 for k in accounts.EXPENSES} | {"charges": 110},
        {"chiffre_affaires": 1000, "charges": 400, "resultat_exploitation": 890} | {k: 10 for k in accounts.EXPENSES[:11]} | {"charges": 110},
    ],
)
def test_correct_accounts_pass(spark, values):
    assert len(accounts.EXPENSES) == 11 and accounts.checks(lines(spark, **values)).collect() == []


def test_wrong_accounts_do_not(spark):
    got = accounts.checks(lines(spark, capitaux_propres=500, total_passif=1000, total_actif=2000, creances_clients=2000)).collect()
    assert {(r.check, r.period, r.lhs, r.rhs) for r in got} == {("passif", "n", 500.0, 1000.0), ("croise", "n", 2000.0, 1000.0)}


def test_quality_counts_a_cross_check_for_both_tables(spark):
    found = lines(spark, total_actif=2000, total_passif=1000)
    r = accounts.quality(found, accounts.checks(found)).first()
    # a mapped and a critical line on each side, two errors
    assert (r.score, r.errors, r.retry) == (2 * (1 + 3) - 12, 2, True)
    assert r.reasons == "2 incohérence(s) comptable(s) détectée(s) ; score global trop faible"
    raw = spark.createDataFrame([("c", "actif", "raw_unmatched_actif_000", 0, "x", 3e9, None), ("c", "passif", "total_passif", 1, "y", 1.0, None)], LINES)
    r = accounts.quality(raw, accounts.checks(raw)).first()
    assert r.reasons == "actif: lignes chiffrées non mappées ; actif: montants suspects ou concaténés ; score global trop faible" and r.score == 4 - 4 - 8


def test_overlays_that_say_something(spark):
    rows = lambda *xs: spark.createDataFrame([("c", *x) for x in xs], "company string, field string, value string")
    first = rows(("bilan_actif_table", "[1]"), ("bilan_passif_table", "[2]"), ("nom", "A"), ("bilan_societe_nom", None))
    second = rows(("bilan_actif_table", "[]"), ("bilan_passif_table", "[3]"), ("nom", "B"), ("bilan_societe_nom", "S"), ("bilan_date_arrete_n", "2020"), ("autre", "x"))
    score = lambda a, b: spark.createDataFrame([("c", a, b)], "company string, first_score int, second_score int")
    got = lambda s: {r.field: r.value for r in accounts.better(first, second, s).collect()}
    assert got(score(1, 2)) == {"bilan_actif_table": "[1]", "bilan_passif_table": "[3]", "nom": "A", "bilan_societe_nom": "S", "bilan_date_arrete_n": "2020"}
    assert got(score(2, 2)) == {"bilan_actif_table": "[1]", "bilan_passif_table": "[2]", "nom": "A", "bilan_societe_nom": None}


def test_a_label_twice_in_the_registry(spark):
    rows = lambda *xs: spark.createDataFrame([("c", "actif", *x) for x in xs], "company string, section string, label string, ordinal int, n double, n1 double")
    got = accounts.four_columns(rows(("A", 0, 1.0, None), ("B", 1, 2.0, None), ("A", 2, 3.0, None)), rows(("A", 0, 10.0, None), ("A", 1, 20.0, None), ("C", 2, 30.0, None), (" ", 3, 1.0, None))).orderBy("place").collect()
    assert [(r.label, r.document_n, r.registry_n) for r in got] == [("A", 1.0, 20.0), ("B", 2.0, None), ("A", 3.0, 20.0), ("C", None, 30.0)]


def test_labels_as_statements_have_them(spark):
    given = {
        "actif": {
            "Frais d'établissement": ("autres_actif_residuel", False), "Frais de recherche et développement": ("autres_actif_residuel", False), "Taxe sur la valeur ajoutée": ("autres_creances", False), "Immobilisations corporelles en cours": ("immobilisations_corporelles", False),
            "Autres créances diverses": ("autres_creances", False), "Banques": None, "Total actif circulant": None, "Net des immobilisations financières": ("immobilisations_financieres", True), "Total général": ("total_actif", True),
        },
        "passif": {"Ecarts de réévaluation": ("capitaux_propres_detail", False), "Total dettes d'exploitation": ("dettes_exploitation", True), "Ecarts de révaluation": ("capitaux_propres_detail", False), "Dettes": None, "Capital": ("capital_social", True)},
        "compte_resultat": {
            "Reprise sur amortissements et provisions": ("reprises_exploitation", True), "Reprise sur amortissements et provisions, transferts de charges": ("reprises_exploitation", True), "Variation de stock marchandises": ("variation_stock_marchandises", True),
            "Variation de stock matières premières": ("variation_stock_matieres_premieres", True), "Achats de matièspremières et autres approvisionnements": ("achats_matieres_premieres", True), "Dotations amortissements": ("dotations_amortissements", True), "Total des produits": None,
        },
    }
    assert accounts.entries()[0][0] == "actif"
    rows = spark.createDataFrame([(t, p) for t, ps in given.items() for p in ps], "table_type string, poste string")
    got = {(r.table_type, r.poste): (r.key, r.is_total) if r.key else None for r in accounts.map_labels(rows, accounts.dictionary(spark)).collect()}
    assert got == {(t, p): k for t, ps in given.items() for p, k in ps.items()}


def test_a_large_dictionary_is_joined_on_grams(spark, monkeypatch):
    words = spark.range(30_000).select(F.lit("actif").alias("table_type"), F.col("id").cast("int").alias("rank"), F.concat(F.lit("ligne"), F.lpad(F.conv("id", 10, 26), 6, "z")).alias("label_key"), F.concat(F.lit("k"), "id").alias("key"), F.lit(True).alias("is_total"))
    words = words.withColumn("label_key", F.translate("label_key", "0123456789", "QRSTUVWXYZ")).withColumn("label_key", F.lower("label_key"))
    one_ = words.where("rank = 17777").first()
    rows = spark.createDataFrame([("actif", f"Total {one_.label_key} net")], "table_type string, poste string")
    found = accounts.map_labels(rows, words)
    assert [(r.key, r.is_total) for r in found.collect()] == [("k17777", True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "strategy=broadcast" not in plan


def test_reports(spark):
    rows = [("immobilisations_corporelles", 100.0, 50.0), ("creances", 20.0, None), ("autres_actif", 5.0, None), ("total_actif", 125.0, None), ("capital_social", 10.0, None), ("resultat_exercice", 15.0, None), ("capitaux_propres", 25.0, None), ("dettes_diverses", 100.0, 50.0), ("total_passif", 120.0, None)]
    found = spark.createDataFrame([("c", *r) for r in rows], "company string, metric string, n double, n1 double")
    got = accounts.balance_report(found).orderBy("place").collect()
    assert len(got) == 21 and [r.label for r in got[:7]] == [*(x for x, _ in accounts.ASSET_LINES), "Total Actif"]
    told = {r.label: (r.n, r.n1) if r.ok_n is None else (r.ok_n, r.ok_n1) for r in got}
    assert told["Total Actif"] == (125.0, 50.0) and told["Total Passif"] == (125.0, 50.0) and told["Stocks"] == (None, None) and told["Total Actif (source doc)"] == (125.0, None)
    assert told["Check équilibre"] == (True, True) and told["Check total actif source"] == (True, True) and told["Check total passif source"] == (False, True) and told["Check résultat"] == (True, True)
    results = spark.createDataFrame([("c", "chiffre_affaires", 200.0, 0.0), ("c", "resultat_exploitation", 50.0, 5.0), ("c", "resultat_net", None, 4.0)], "company string, metric string, n double, n1 double")
    got = [(r.label, r.n, r.n1) for r in accounts.result_report(results).orderBy("place").collect()]
    assert len(got) == 13 and got[6:8] == [("Résultat d'exploitation", 50.0, 5.0), ("En % du CA", 0.25, 0.0)] and got[-2:] == [("Résultat net", None, 4.0), ("En % du CA", 0.0, 0.0)]


def test_periods_of_a_company(spark):
    files = [("S", 2020, "a.pdf", "p/a"), ("S", 2021, "b.pdf", "p/b"), ("S", 2021, "c.pdf", "p/c"), ("S", None, "d.pdf", "p/d"), ("T", None, "e.pdf", "p/e")]
    got = accounts.company_periods(spark.createDataFrame(files, "company_folder string, year int, filename string, source_path string")).orderBy("company_folder", "place").collect()
    assert [(r.company_folder, r.period, [f.name for f in r.files]) for r in got] == [("S", "Bilan 2021", ["c.pdf", "b.pdf"]), ("S", "Bilan 2020", ["a.pdf"]), ("S", "Autres bilans", ["d.pdf"]), ("T", "Autres bilans", ["e.pdf"])]


# --- companies and people ----------------------------------------------------------------------------

FOUND = "person_id int, director_id int, nom string, prenom string, prenom_usuel string, nom_complet string, date_de_naissance string, date_de_naissance_rgpd string, sirens array<string>, ordinal int"


def test_directors_by_month_and_other_names(spark):
    people = spark.createDataFrame([(1, "Dupont", "Lola, Marie", "12/02/1970"), (2, "Durand", "Paul", "1980-05-03"), (3, "Petit", "Anne", None), (4, "Roux", "Luc", "03/1960")], "person_id int, nom string, prenoms string, date_naissance string")
    found = [
        (1, 10, "DUPONT", "Juliette", "Lola", "DUPONT Juliette", None, "1970-02", ["1"], 0), (1, 11, "DUPONT", "Anne", None, None, None, "1970-02", [], 1),
        (2, 20, "DURAND", "Paul", None, "Durand Paul", "1980-05-03", None, ["2", "1"], 0), (2, 21, "DURAND", "Paul", None, "DURAND  paul", "1980-05-03", None, [" 1", "2", "2"], 1), (2, 22, "DURAND", "Paul", None, "Durand Paul", "", "1980-05", ["3"], 2), (2, 23, "DURAND", "Paul", None, "Durand P", "1980-06-03", "1980-05", [], 3),
        (3, 30, None, None, None, "Petit", "1990-01-01", None, ["7"], 0), (3, 31, None, None, None, "petit", "1990-01-01", None, ["7"], 1), (4, 40, "ROUX", "Luc", None, "x", "1960-03-09", None, [], 0),
    ]
    got = {(r.person_id, r.director_id): r.mode for r in companies.match_people(people, spark.createDataFrame(found, FOUND)).collect()}
    assert got == {(1, 10): "date_de_naissance_rgpd", (2, 20): "date_de_naissance_plus_rgpd", (2, 22): "date_de_naissance_plus_rgpd", (3, 30): "candidat_unique", (4, 40): "date_de_naissance_rgpd"}


def test_network_of_a_company(spark):
    """A company as representative, a company reached twice, a ceased one, a predecessor that was visited."""
    reps = [("R", 0, "p1", None, "Gérant"), ("R", 1, None, "A", "Président"), ("R", 2, "p2", None, None), ("A", 0, "p3", None, "DG"), ("B", 0, "p1", None, "Gérant"), ("B", 1, "p4", None, None), ("C", 0, "p3", None, "DG"), ("D", 0, None, "E", None)]
    held = [("p1", 0, "B", "Associé", False), ("p1", 1, "X", None, True), ("p1", 2, "R", None, False), ("p2", 0, "A", None, False), ("p2", 1, "B", None, False), ("p2", 2, "D", None, False)]
    roots = spark.createDataFrame([("R",)], "siren string")
    nodes, edges = companies.network(
        roots, spark.createDataFrame(reps, "siren string, ordinal int, person_id string, company string, qualite string"),
        spark.createDataFrame(held, "person_id string, ordinal int, siren string, qualite string, entreprise_cessee boolean"), spark.createDataFrame([("R", 0, "B"), ("R", 1, "C"), ("R", 2, "R")], "siren string, ordinal int, predecessor string"),
    )
    assert {(r.node, r.rank) for r in nodes.collect()} == {("soc_R", 0), ("p1", 1), ("p2", 1), ("soc_A", 1), ("p3", 2), ("soc_B", 2), ("p4", 3), ("soc_D", 2), ("soc_C", 1)}
    assert sorted((r.src, r.dst, r.label, r.dashed) for r in edges.collect()) == sorted([
        ("soc_R", "p1", "Gérant", False), ("soc_R", "p2", "Dirigeant", False), ("soc_R", "soc_A", "Président", False), ("soc_A", "p3", "DG", False), ("p1", "soc_B", "Associé", False), ("soc_B", "p1", "Gérant", False), ("soc_B", "p4", "Dirigeant", False),
        ("p2", "soc_D", "Dirigeant", False), ("soc_R", "soc_C", "Prédécesseur", True), ("soc_C", "p3", "DG", False),
    ])


def test_catalogue_keeps_the_last_of_the_cache(spark):
    people = spark.createDataFrame([("p", "Hélène N", 0, "d"), ("p", "helene n", 1, "d"), ("p", " ", 2, "Dossier X")], "project_id string, name string, ordinal int, folder string")
    firms = spark.createDataFrame([("p", "SCI Nord", 0, "cache"), ("p", "SCI NORD", 1, "cache"), ("p", "sci nord", 2, "extraction"), ("p", "Est", 3, "extraction"), ("p", "EST", 4, "extraction"), ("p", " ", 5, "cache"), ("p", None, 6, "cache")], "project_id string, name string, ordinal int, source string")
    assert {(r.kind, r.key, r.name) for r in companies.catalogue(people, firms).collect()} == {("person", "helene n", "helene n"), ("person", "dossier x", "Dossier X"), ("company", "sci nord", "SCI NORD"), ("company", "est", "Est")}


def test_merged_companies(spark):
    rows = [("1", "A", 1, "", None, []), ("1", "B", 0, None, 3.0, ["x"]), ("", "Nord", 2, "r", None, None), (None, " NORD ", 3, "s", 1.0, None), (None, " ", 4, "t", 1.0, None)]
    got = companies.merge_companies(spark.createDataFrame(rows, "siren string, nom string, ordinal int, role string, capital double, activites array<string>")).collect()
    assert {(r.key, r.nom, r.role, r.capital, tuple(r.activites or ()), r.ordinal) for r in got} == {("1", "B", None, 3.0, ("x",), 0), ("nord", "Nord", "r", 1.0, (), 2)}


# --- containment -------------------------------------------------------------------------------------


def test_containment_as_all_pairs(spark):
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))) for _ in range(150)})
    rows = spark.createDataFrame([("p" if i % 3 else "q", k) for i, k in enumerate(keys)], "project_id string, key string")
    got = {(r.project_id, r.a, r.b) for r in matching.containment(rows, rows, ["project_id"]).collect()}
    by = {"p": [k for i, k in enumerate(keys) if i % 3], "q": [k for i, k in enumerate(keys) if not i % 3]}
    assert got == {(p, a, b) for p, ks in by.items() for a in ks for b in ks if a in b}


def test_frequent_words_pair_nothing(spark):
    """Ten thousand addresses of one street: each meets itself and few others."""
    rows = spark.range(10_000).select(F.lit("p").alias("project_id"), F.concat(F.lpad("id", 5, "0"), F.lit(" rue de la paix 75002 paris")).alias("key"))
    some = rows.select("project_id", F.col("key").alias("a"), F.lit("").alias("tag"), F.explode(matching.held_parts(F.col("key"))).alias("part"), F.lit(1).alias("need"))
    all_ = rows.select("project_id", F.col("key").alias("b"), F.lit("").alias("tag"), F.explode(matching.holding_parts(F.col("key"))).alias("part"))
    assert matching.candidates(some, all_, ["project_id"]).count() < 300_000
    assert matching.containment(rows, rows, ["project_id"]).count() == 10_000


def test_location_of_agreeing_documents(spark):
    rows = [("p", 1, 0, "12 rue de la Paix"), ("p", 2, 1, "12 rue de la paix, 75002 Paris"), ("p", 3, 2, "8 avenue Foch"), ("p", 3, 3, "8 avenue Foch 75016"), ("q", 1, 0, "1 rue A"), ("q", 1, 1, "1 rue A"), ("r", 1, 0, "Paris")]
    got = {r.project_id: r.location for r in answers.project_location(spark.createDataFrame(rows, "project_id string, document_id int, ordinal int, value string")).collect()}
    assert got == {"p": "12 rue de la paix, 75002 Paris"}


def test_many_rules_as_few(spark, monkeypatch):
    files = spark.createDataFrame([("p", f"A/{d}/doc {i}.pdf", f"doc {i} {w}.pdf") for i, (d, w) in enumerate([("RH", "bilan annuel"), ("Bilans", "kbis"), ("RH", "x"), ("Autre", "Bilan")])], "project_id string, source_path string, filename string")
    rules = spark.createDataFrame([("f1", ["*RH"], ["bilan", "kbis"]), ("f2", None, ["kbis", ""]), ("f3", [], ["Bilan"]), ("f4", ["RH"], None), ("f5", ["Bilans"], ["rh"])], "field_id string, source_dirs array<string>, hint_keywords array<string>")
    found = lambda: {(r.filename, r.field_id) for r in answers.match_rules(files, rules).collect()}
    few = found()
    monkeypatch.setattr(answers, "MOST_RULES", 2)
    assert found() == few and len(few) >= 4


def test_groups_of_many_sources(spark, monkeypatch):
    rows = spark.createDataFrame([("c", "B1", "x", 0, 1.0, None), ("d", "", "Résultat", 0, 2.0, 3.0)], "company string, code string, label string, ordinal int, n double, n1 double")
    groups = spark.createDataFrame([("G", ["B1", "resultat"]), ("H", ["ZZ"])], "label string, sources array<string>")
    found = lambda: {(r.company, r.label, r.n, r.n1) for r in accounts.group_values(rows, groups).collect()}
    few = found()
    monkeypatch.setattr(accounts, "MOST_WORDS", 1)
    assert found() == few == {("c", "G", 1.0, None), ("c", "H", None, None), ("d", "G", 2.0, 3.0), ("d", "H", None, None)}


# --- comparables, incremental runs -------------------------------------------------------------------


def test_a_missing_street_is_the_address_own(spark):
    day = dt.date(2020, 1, 1)
    subject = [(1, 48.0, 2.0, "appartement", 50.0, 2, None, 500, 2000, day, None, "12 rue Foch"), (2, 48.0, 2.0, "appartement", 50.0, 2, None, 500, 2000, day, " ", None)]
    schema = "subject_id int, lat double, lon double, property_type string, living_area_sqm double, rooms int, land_area_sqm double, search_radius_m int, min_year int, valuation_date date, street_name string, normalized_address string"
    sale = [(200_000.0, 50.0, 2, dt.date(2019, 6, 1), "appartement", "RUE FOCH", 3, 48.0005, 2.0, 0.0)]
    sales = spark.createDataFrame(sale, "total_price double, living_area double, rooms int, sale_date date, property_type string, street string, number int, lat double, lon double, land_area double")
    score = {r.subject_id: r.score for r in comparables.candidates(spark.createDataFrame(subject, schema), sales).withColumn("score", comparables.similarity()).collect()}
    assert score[1] > score[2]


def test_missing_people_are_computed_anew(spark):
    prints = lambda *rows: spark.createDataFrame(rows, "project_id string, people string, financial string, people_inputs int, financial_inputs int")
    now = prints(("same", "a", "x", 1, 1), ("changed", "b", "x", 1, 1), ("none", "a", "x", 1, 1), ("file", "a", "y", 1, 1), ("nothing", "a", "x", 0, 0), ("new", "a", "x", 2, 0))
    before = prints(*((p, "a", "x", 1, 1) for p in ("same", "changed", "none", "file", "nothing")))
    stored = spark.createDataFrame([("same", 3, True), ("changed", 3, True), ("none", 0, True), ("file", 3, False), ("nothing", 0, False)], "project_id string, persons int, has_file boolean")
    got = {r.project_id: (r.people_recomputed, r.financial_recomputed) for r in incremental.refresh_decision(before, now, stored).collect()}
    assert got == {"same": (False, False), "changed": (True, False), "none": (True, False), "file": (True, True), "nothing": (False, False), "new": (True, True)}


FILES = "project_id string, source_path string, file_size_bytes long, modified_at timestamp"


def test_stream_restarts_late_files_and_repeats(spark, tmp_path):
    base = str(tmp_path)
    day = lambda n: dt.datetime(2024, 1, n)

    def arrive(*rows):
        spark.createDataFrame([("p", p, s, d) for p, s, d in rows], FILES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = ingest.ingest(ingest.arriving(spark, f"{base}/in", spark.createDataFrame([], FILES).schema), f"{base}/manifest", f"{base}/check", within="1 hour", buckets=8)
        query.awaitTermination()
        return sorted((r.source_path, r.file_size_bytes) for r in spark.read.parquet(f"{base}/manifest").collect()), query

    got, _ = arrive(("a", 1, day(9)), ("b", 1, day(9)), ("a", 1, day(9)))
    assert got == [("a", 1), ("b", 1)]
    # another run of the program: a repeat, a changed size, a file that is older than all before
    got, query = arrive(("a", 1, day(10)), ("b", 2, day(10)), ("old", 5, dt.datetime(2001, 1, 1)))
    assert got == [("a", 1), ("b", 1), ("b", 2), ("old", 5)]
    assert any(p.stateOperators for p in query.recentProgress)
    # what neither the state nor this epoch knows, the manifest tells
    held = spark.read.parquet(f"{base}/manifest")
    assert held.select("epoch").distinct().count() == 2


def test_the_manifest_tells_what_the_state_forgot(spark, tmp_path):
    base = str(tmp_path)
    schema = spark.createDataFrame([], FILES).schema

    def arrive(*paths):
        spark.createDataFrame([("p", x, 1, dt.datetime(2024, 1, 1)) for x in paths], FILES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        # every repeat comes as if it were new: no key is remembered
        stream = ingest.arriving(spark, f"{base}/in", schema)
        ingest.ingest(stream.withColumn("file_size_bytes", F.col("file_size_bytes")), f"{base}/manifest", f"{base}/check", within="0 seconds", buckets=4).awaitTermination()

    arrive("a", "b")
    arrive("a", "c")
    arrive("a", "b", "d")
    assert sorted(r.source_path for r in spark.read.parquet(f"{base}/manifest").collect()) == ["a", "b", "c", "d"]


def test_batches_read_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(4000).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), "id").alias("source_path"), F.lit(1).cast("long").alias("file_size_bytes"), F.current_timestamp().alias("modified_at"), F.lit(0).alias("epoch"))
    rows.withColumn("bucket", ingest.bucket(32)).write.partitionBy("bucket", "epoch").parquet(path)
    some = [r.b for r in spark.createDataFrame([("p", "f7", 1)], "project_id string, source_path string, file_size_bytes long").select(ingest.bucket(32).alias("b")).collect()]
    read = ingest.known(spark, path).where(F.col("bucket").isin(some))
    assert 0 < read.count() < 400 and "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString()
    assert ingest.known(spark, path + "-none") is None


def test_similar_names_below_the_bound_meet_by_no_frequent_word(spark):
    """Three words of which one is everywhere: a shared third scores nothing."""
    folders = spark.createDataFrame([("p", "Groupe Alpha Beta")], "project_id string, folder string")
    pool = spark.createDataFrame([("p", str(i), f"Groupe X{i} Y{i}", i) for i in range(50)] + [("p", "50", "Alpha Beta Gamma", 50)], "project_id string, siren string, nom string, ordinal long")
    (r,) = companies.best_matches(folders, pool).collect()
    assert r.nom == "Alpha Beta Gamma" and r.score > 0.6
