"""Literal cases for what the queries' tables do not show."""

import json

from pyspark.sql import functions as F

from cadaster.functions import labels
from cadaster.operators import accounts, answers, companies, corpus, grids, quotes
from cadaster.sources import inventory


def test_statement_pages(spark):
    pages = [
        (1, 1, ["Voir le bilan actif en annexe 3"]), (1, 2, ["  Bilan  Actif "]), (1, 3, ["bilan actif"]),
        (2, 1, ["capital social", "report à nouveau"]), (2, 2, ["Capital social", "Report a nouveau", "résultat de l'exercice"]),
        (3, 1, ["Sommaire", "Compte de résultat"]), (3, 2, ["Compte de résultat (suite)"]), (3, 3, ["Chiffre d'affaires", "charges d'exploitation", "actif immobilisé", "actif circulant"]),
        (4, 1, [*["x"] * 8, "Bilan passif"]), (5, 1, ["Bilan actif", "Bilan passif"]), (5, 2, ["Bilan passif"]), (6, 1, []), (7, 1, None),
    ]
    got = {(r.doc_id, r.section): r.page for r in grids.statement_pages(spark.createDataFrame(pages, "doc_id long, page int, lines array<string>")).collect()}
    assert got == {(1, "bilan_actif"): 2, (2, "bilan_passif"): 2, (3, "bilan_actif"): 3, (5, "bilan_actif"): 1, (5, "bilan_passif"): 2}


def test_missing_types(spark):
    rows = [(1, "maison", "ok"), (1, "appartement", "error"), (2, "maison", "error"), (3, "maison", "ok"), (3, "appartement", "ok")]
    got = {r.subject_id: r.missing for r in quotes.missing_types(spark.createDataFrame(rows, "subject_id long, property_type string, status string"), ["appartement", "maison"]).collect()}
    assert got == {1: "appartement", 2: "appartement,maison", 3: ""}


def test_metrics_subtract_and_fall_back(spark):
    keys = ["production_stockee", "subventions_exploitation", "reprises_exploitation", "autres_produits_exploitation", "autres_charges_exploitation"]
    lines = [("a", k, i, float(10**i), None) for i, k in enumerate(keys)] + [("b", keys[0], 0, 7.0, 2.0), ("b", "stocks", 1, None, 5.0)]
    told = [("b", "bilan_stocks_n", "1 250"), ("b", "bilan_stocks_n1", "9"), ("b", "bilan_capital_social_n", "100"), ("b", "bilan_creances_n", "3"), ("b", "bilan_dettes_diverses_n", "rien")]
    lines = spark.createDataFrame(lines, "company string, key string, idx int, n double, n1 double")
    got = {(r.company, r.metric): (r.n, r.n1) for r in accounts.metrics(lines, spark.createDataFrame(told, "company string, field_id string, value string")).collect()}
    assert got["a", "autres_elements"] == (10000.0 - 1111.0, None) and got["b", "autres_elements"] == (-7.0, -2.0)
    assert got["b", "stocks"] == (1250.0, 5.0) and got["b", "capital_social"] == (100.0, None) and ("b", "creances") not in got
    assert got["b", "dettes_diverses"] == (None, None)


def test_labels_and_what_follows_from_them(spark):
    given = {
        "actif": {"Total immobilisations corporelles": "immobilisations_corporelles", "VMP": "vmp", "Trésorerie": "tresorerie", "Total actif circulant": None, "Zzz": None},
        "passif": {"Capital social": "capital_social", "Résultat de l'exercice": "resultat_exercice", "Report à nouveau": "capitaux_propres_detail", "Dettes fiscales sociales": "dettes_fiscales_sociales", "Total des dettes": None},
        "compte_resultat": {"Impôts taxes et versements assimilés": "impots_taxes", "Produits financiers": None, "IS": "impots_sur_les_societes", "Total des charges d'exploitation": "charges"},
    }
    rows = spark.createDataFrame([(t, p) for t, ps in given.items() for p in ps], "table_type string, poste string")
    got = {(r.table_type, r.poste): r.key for r in accounts.map_labels(rows, accounts.dictionary(spark)).collect()}
    assert got == {(t, p): k for t, ps in given.items() for p, k in ps.items()}


def test_filings_of_both_shapes(spark):
    flat = {"entries": [{"y": "2020", "lines": [{"side": "passif", "code": "1", "label": "L", "n": 2.0}]}]}
    nested = {"2021": [{"sections": [{"libelle": "Bilan Actif", "liasses": [{"code": "028", "libelle": "M", "colonnes": [{"libelle": "Net année N", "valeur": 3.0}]}]}]}]}
    rows = spark.createDataFrame([("s1", json.dumps(flat)), ("s2", json.dumps(nested)), ("s3", "?"), ("s4", None)], "siren string, payload string")
    got = sorted((r.siren, r.year, r.side, r.label, r.n) for r in accounts.flatten_filings(rows).collect())
    assert got == [("s1", "2020", "passif", "L", 2.0), ("s2", "2021", "actif", "M", 3.0)]


def packed(sizes, most, overlap):
    """pack_pieces() in plain Python."""
    out, first = [], 0
    for i, size in enumerate(sizes):
        if i > first and sum(sizes[first:i]) + size > most:
            out.append((first, i - 1))
            first = next(j for j in range(first + 1, i + 1) if sum(sizes[j:i]) <= overlap and (sum(sizes[j:i]) + size <= most or j == i))
    return [*out, (first, len(sizes) - 1)] if sizes else out


def test_pieces_are_packed_with_overlap(spark):
    import random

    rng = random.Random(1)
    cases = [([rng.randrange(1, 12) for _ in range(rng.randrange(0, 30))], rng.randrange(5, 40), rng.randrange(0, 9)) for _ in range(60)]
    for most, overlap in {(m, o) for _, m, o in cases}:
        given = [(i, s) for i, (s, m, o) in enumerate(cases) if (m, o) == (most, overlap)]
        rows = spark.createDataFrame(given, "i int, sizes array<int>").select("i", corpus.pack_pieces(F.col("sizes"), most, overlap).alias("x")).collect()
        assert {r.i: [tuple(x) for x in r.x] for r in rows} == {i: packed(s, most, overlap) for i, s in given}


def test_children(spark):
    header, row = "| Lot | Prix |\n|---|---|", "| A{} appartement de trois pièces | 4 200 € |"
    table = header + "\n" + "\n".join(row.format(i) for i in range(12))
    prose = " ".join(f"Phrase numéro {i} d'un texte assez long pour être coupé en morceaux." for i in range(30))
    parents = [("p1", "d", "Lots", table), ("p2", "d", "Texte", prose), ("p3", "d", "Contents", table), ("p4", "d", "Court", "trop court"), ("p5", "d", None, "")]
    got = {}
    for r in corpus.children(spark.createDataFrame(parents, "parent_id string, document_id string, title string, text string"), 60, 15).orderBy("chunk_id").collect():
        got.setdefault(r.parent_id, []).append(r.text)
    assert all(t.startswith(header + "\n") and len(t) <= 4 * 60 for t in got["p1"]) and "\n".join(t[len(header) + 1 :] for t in got["p1"]) == table[len(header) + 1 :]
    assert all(len(t) <= 4 * 60 for t in got["p2"]) and all(f"numéro {i} " in " ".join(got["p2"]) for i in range(30)) and len(got["p2"]) > 5
    assert not got["p3"][1].startswith(header) and set(got) == {"p1", "p2", "p3"}


def test_column_aliases(spark):
    rows = [(1, {"TypeDeBien": "APT", "estimation_actuelle": "630000", "capital_restant_du": "525000"}), (2, {"type_detention": "SCI", "valeur_bien": None, "valeur_venale": "12"}), (3, {})]
    wanted = ["type_bien", "type_de_detention", "valeur_bien", "valeur_banque", "valeur_nette_detenue"]
    got = {r.i: tuple(r)[1:] for r in spark.createDataFrame(rows, "i int, cells map<string,string>").select("i", *labels.aliased(F.col("cells"), wanted)).collect()}
    assert got == {1: ("APT", None, "630000", "525000", "105000"), 2: ("SCI", "SCI", "12", None, None), 3: (None,) * 5}


def test_record_names(spark):
    names = {"Casier judiciaire.pdf": True, "cassier judiciare Dupont.pdf": True, "Bulletin N°3 Dupont.pdf": True, "bulletin numero 3 x": True, "Kbis.pdf": False, "casier.pdf": False, "Bulletin de paie n 2": False, "": False, None: False}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.is_record for r in labels.record_names(rows, "name").collect()} == names


def test_comments_and_cards(spark):
    c = companies.merged_comments(F.lit(" Radiée  le 1 "), F.lit("RADIÉE LE 1"), F.lit(None).cast("string"), F.lit("Autre"))
    assert spark.range(1).select(c, companies.merged_comments(F.lit(" "), F.lit(None).cast("string"))).first() == ("Radiée le 1\nAutre", None)
    rows = spark.createDataFrame([("d", "p", "2", "B", 2), ("d", "p", "1", "A", 1), ("d", "q", "3", "C", 1)], "folder string, person_id string, siren string, nom string, ordinal int")
    got = {r.person_id: (r.value, [x.nom for x in r.companies]) for r in companies.person_cards(rows).collect()}
    assert got == {"p": ("2 société(s) trouvée(s)", ["A", "B"]), "q": ("1 société(s) trouvée(s)", ["C"])}


def test_context_variants(spark):
    rows = [("d", i, ch * n, h) for i, (ch, n, h) in enumerate((("a", 300, 1), ("b", 100, 0), ("c", 400, 2), ("e", 90, 0), ("f", 40, 0), ("g", 600, 0)))] + [("n", 0, "x" * 60, 0), ("n", 1, "y" * 2000, 0), ("n", 2, "z" * 60, 0)]
    df = spark.createDataFrame(rows, "document_id string, index int, text string, hits int")
    kept = lambda **k: [(r.document_id, r.kept[0], len(r.kept)) for r in corpus.context(df, 1000, **k).orderBy("document_id", "place").collect()]
    assert kept() == [("d", "c", 400), ("d", "a", 300), ("n", "x", 60)]
    assert kept(tail=True) == [("d", "c", 400), ("d", "a", 300), ("d", "b", 100), ("d", "e", 90), ("n", "x", 60)]
    assert [(r.kept[0], len(r.kept)) for r in corpus.head(df.where("document_id = 'd'"), 500).orderBy("index").collect()] == [("a", 300), ("b", 100), ("c", 100)]


def test_rules_of_any_number(spark):
    files = spark.createDataFrame([("A/b.pdf", "b.pdf")], "source_path string, filename string")
    rules = spark.range(answers.MOST_RULES + 1).selectExpr("cast(id AS string) AS field_id", "array('A') AS source_dirs", "array('b') AS hint_keywords")
    assert answers.match_rules(files, rules).select("field_id").distinct().count() == answers.MOST_RULES + 1
    assert [r.field_id for r in answers.match_rules(files, rules.limit(1)).collect()] == ["0"] and answers.match_rules(files, rules.limit(0)).count() == 0


def test_results_are_replaced(spark, tmp_path):
    for n in (3, 2):
        inventory.write_results(spark.range(n).withColumn("k", F.col("id") % 2), str(tmp_path / "r"), "json", ["k"])
    assert spark.read.json(str(tmp_path / "r")).count() == 2
