"""Literal cases with results worked by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from cadaster.functions import labels, numbers, text
from cadaster.operators import comparables, corpus, grids, quotes
from cadaster.sources import inventory
from cadaster.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def compared(spark):
    subject = spark.createDataFrame([(1, 48.868, 2.331, "appartement", 50.0, 2, None, "Rue de la Paix", 500, 2024, datetime.date(2025, 6, 1))], "subject_id long, lat double, lon double, property_type string, living_area_sqm double, rooms int, land_area_sqm double, street_name string, search_radius_m int, min_year int, valuation_date date")
    rows = [(1, 250000.0, "2025-01-15", 2.3312, 48.8681), (2, 255000.0, "2025-01-15", 2.3314, 48.8682), (3, 260000.0, "2025-01-15", 2.3316, 48.8683), (4, 252500.0, "2025-01-15", 2.3318, 48.8684), (5, 75000.0, "2025-01-15", 2.3320, 48.8685), (1, 251000.0, "2024-09-20", 2.3312, 48.8681)]
    sales = spark.createDataFrame([(p, 50.0, 2, datetime.date.fromisoformat(d), "appartement", "Rue de la Paix", n, la, lo, None) for n, p, d, lo, la in rows], "total_price double, living_area double, rooms int, sale_date date, property_type string, street string, number int, lat double, lon double, land_area double")
    return comparables.compare(subject, sales)


def test_comparables(compared):
    s = comparables.statistics(compared).first()
    assert (s.found, s.retained, s.excluded) == (6, 4, 2)
    assert (s.average_price_m2, s.median_price_m2, s.min_price_m2, s.max_price_m2) == (5092.5, 5075.0, 5020.0, 5200.0)
    assert {r.reason for r in compared.collect()} == {None, "price_outlier_low", "duplicate_recent_sale"}


def test_numbers_and_headers(spark):
    assert one(spark, numbers.signed_amount(F.lit("530 000 €"))) == 530000
    assert one(spark, numbers.signed_amount(F.lit("(12000)"))) == -12000
    assert one(spark, numbers.signed_amount(F.lit("APT"))) is None
    for given, key in (("Type de détention (3)", "typededetention"), ("% de détention", "dedetention"), ("Estimation actuelle", "estimationactuelle"), ("Capital restant dû", "capitalrestantdu")):
        assert one(spark, grids.header_key(F.lit(given))) == key


def test_property_grid(spark):
    header = ["Type de bien (1)", "Adresse et destination (2)", "Surface habitable", "Type de détention (3)", "% de détention", "Valeur d'acquisition", "Estimation actuelle", "Capital restant dû", "Garanties données (4)", "Revenus locatifs"]
    rows = [["APT", "51 BLD DU SABLIER 13008 MARSEILLE (RP)", "92", "INDIVISIO", "50", "530000", "630000", "525000", "CP", "0"], [""] * 10, ["MAISO", "43 RUE JEAN BART 59200 TOURCOING (RL)", "120", "SCI", "50", "194000", "382000", "170000", "HP", "3000"]]
    table = spark.createDataFrame([(1, [header, *rows]), (2, [["a", "b"], ["c", "d"]])], "doc_id long, cells array<array<string>>")
    found = grids.header_records(table).orderBy("row").collect()
    assert [(r.type_bien, r.surface, r.estimation_actuelle, r.revenus_locatifs) for r in found] == [("APT", 92.0, 630000.0, 0.0), ("MAISO", 120.0, 382000.0, 3000.0)]
    assert grids.holdings(grids.header_records(table)).first().net == (630000 - 525000) + (382000 - 170000)


def test_lot_totals(spark):
    lots = spark.createDataFrame([("p", "A01", 45.5, 191100.0, 0.0), ("p", "A02", 62.0, 266600.0, 10000.0)], "project string, lot string, area double, price double, deposit double")
    total = grids.with_totals(lots, "project", "lot", ["area", "price", "deposit"]).where("lot = 'Total'").first()
    assert (total.area, total.price, total.deposit) == (107.5, 457700.0, 10000.0)


def test_quotes(spark):
    schema = f"source string, subject_id int, property_type string, prix array<struct<{quotes.BLOCK}>>, tranche_basse double, prix_m2_moyen double, tranche_haute double, error string, status string"
    rows = [
        ("consortium_immobilier", 1, "maison", [("maison", 8200.0, 9100.0, 10200.0)], None, None, None, None, None),
        ("terrain_construction", 1, "maison", None, None, 3500.0, None, None, None),
        ("meilleursagents", 1, "maison", None, 8700.0, 9400.0, 10100.0, None, None),
        ("lesclesdumidi", 1, "maison", [], None, None, None, "absent", None),
    ]
    found = {r.source: r for r in quotes.normalise(spark.createDataFrame(rows, schema)).collect()}
    assert [(found[s].low, found[s].mid, found[s].high, found[s].status) for s in quotes.SOURCES] == [(8200, 9100, 10200, "ok"), (None, None, None, "error"), (None, 3500, None, "ok"), (8700, 9400, 10100, "ok")]
    ok = spark.createDataFrame([("a", 1, None, 8000.0, 9000.0, 10000.0, None, "ok"), ("b", 1, None, 8200.0, 9400.0, 10600.0, None, "ok")], "source string, subject_id int, property_type string, low double, mid double, high double, error string, status string")
    average = quotes.with_average(ok).where("status = 'synthese'").first()
    assert (average.low, average.mid, average.high) == (8100, 9200, 10300)


def test_departments_and_sources(spark):
    for code, department in (("75002", "75"), ("97400", "974"), ("20137", "2A"), ("20200", "2B")):
        assert one(spark, labels.department(F.lit(code))) == department
    asked = quotes.requests(spark.createDataFrame([(1, "Paris", "75002", "appartement")], "subject_id int, city string, postcode string, property_type string"))
    assert {r.source: r.status for r in asked.collect()}["terrain_construction"] == "skipped"


def test_snapshots(spark, tmp_path):
    now = datetime.datetime(2025, 1, 1)
    rows = [("project-123", now, "old", "d1"), ("project-123", now + datetime.timedelta(days=1), "new", "d2")]
    for row in rows:
        quotes.append_snapshots(spark.createDataFrame([row], "key string, cached_at timestamp, payload string, day string"), str(tmp_path / "s"))
    assert quotes.latest(spark.read.parquet(str(tmp_path / "s"))).first().payload == "new"


def test_names(spark):
    for given, name in (("0. Opérateur", "operateur"), ("2. Audit", "audit"), ("Audit 1", "audit"), ("X. audit", "audit"), ("10.0 x", "10.0 x")):
        assert one(spark, text.canonical_name(F.lit(given))) == name
    has = lambda p, t: one(spark, text.path_has_segments(F.lit(p), F.lit(t)))
    assert has("2. Audit /1. Opérateur/3. RH/Pernod/file.pdf", "2. Audit/1. Opérateur/3. RH") and not has("Audit/Opérateur/Société Emprunteuse/kbis.pdf", "Société Opération")
    person = lambda p: one(spark, text.person_folder(F.lit(p)))
    assert person("Audit/Opérateur/Ressources Humaines/Juliette/file.pdf") == "Juliette" and person("Audit/3. RH/file.pdf") is None


def test_sections(spark):
    rows = spark.createDataFrame([(1, "intro text\n# One\nbody\n**ARTICLE 2** end\nmore"), (2, "")], "document_id long, text string")
    assert [(r.section, r.title) for r in corpus.sections(rows).orderBy("document_id", "section").collect()] == [(0, "Introduction"), (1, "One"), (2, "ARTICLE 2 end")]


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"fields": [{"field_id": "x", "hint_keywords": ["k"]}, {"label": "none"}]}))
    assert [r.field_id for r in inventory.rules(spark, str(tmp_path)).collect()] == ["x"]
    (tmp_path / "b.json").write_text(json.dumps({"fields": [{"field_id": "x"}]}))
    with pytest.raises(ValueError, match="x"):
        inventory.rules(spark, str(tmp_path))


def test_files_and_texts(spark, tmp_path):
    (tmp_path / "old").mkdir()
    for name in ("a.txt", "b.md", "c.zip", "old/d.txt"):
        (tmp_path / name).write_text(f"text of {name}\nline")
    assert sorted(r.source_path for r in inventory.file_inventory(spark, str(tmp_path)).collect()) == ["a.txt", "b.md"]
    assert sorted(r.file_type for r in inventory.whole_texts(spark, str(tmp_path)).collect()) == ["md", "txt", "txt"]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"project_id": "p", "files": [{"source_path": "a", "file_size_bytes": 3}, {"source_path": "", "file_size_bytes": 3}, {"source_path": "b", "file_size_bytes": "x"}]}))
    assert [r.cache_key for r in inventory.manifest(spark, str(tmp_path)).collect()] == ["a::3"]


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = "project_id string, source_path string, file_size_bytes long, modified_at timestamp"
    now = datetime.datetime(2025, 1, 1)
    for batch in ([("p", "a", 1, now), ("p", "a", 1, now)], [("p", "a", 1, now), ("p", "a", 2, now)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.arriving(spark, str(tmp_path / "in"), schema), str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.file_size_bytes for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 2]
