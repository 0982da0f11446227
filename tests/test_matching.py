"""Name matching against all pairs of a project."""

import pytest
from pyspark.sql import functions as F

from cadaster.functions import labels
from cadaster.operators import answers, companies

FOLDERS = ["FD", "Lumière", "SCI F.D.", "Les Lumières du Nord", "SCI", "A", "Groupe Est", "Société Ouest 3", "SASé Conseil", "X-Y"]
POOL = ["SCI F.D.", "LesLumieres", "FD", "Lumière", "SARL", "Nord", "Ouest", "Conseil de l'Est", "xyz", "É", "Autre"]


@pytest.fixture(scope="module")
def names(spark):
    folders = spark.createDataFrame([(p, f) for p in ("p", "q") for f in FOLDERS] + [("r", "FD"), ("s", "Lumière")], "project_id string, folder string")
    pool = [("p", str(i), n, i) for i, n in enumerate(POOL)] + [("q", str(i), n, i) for i, n in enumerate(POOL[5:])] + [("r", "1", "Autre", 1), ("r", "2", "SCI F.D.", 2), ("s", "1", "LesLumieres", 1)]
    return folders, spark.createDataFrame(pool, "project_id string, siren string, nom string, ordinal long")


def test_compact_forms_meet(names):
    best = {(r.project_id, r.folder): (r.nom, r.score) for r in companies.best_matches(*names).collect()}
    assert best["r", "FD"] == ("SCI F.D.", 1.0)
    assert best["s", "Lumière"] == ("LesLumieres", 0.8)


def test_same_as_all_pairs(names):
    folders, pool = names
    score = F.greatest(labels.similarity(F.col("folder"), F.col("nom")), labels.similarity(F.col("nom"), F.col("folder")))
    expected = {}
    for r in folders.join(pool, "project_id").withColumn("score", score).where(F.col("score") > companies.MATCH_ABOVE).orderBy("ordinal").collect():
        if r.score > expected.get((r.project_id, r.folder), ("", 0))[1]:
            expected[r.project_id, r.folder] = (r.siren, r.score)
    assert {(r.project_id, r.folder): (r.siren, r.score) for r in companies.best_matches(*names).collect()} == expected


def test_earlier_pool_wins(names):
    folders, pool = names
    tiers = [pool.where("nom = 'SCI F.D.'"), pool]
    assert {r.project_id: r.match_tier for r in companies.cascade(folders.where("folder = 'FD'"), tiers).collect() if r.project_id in "pr"} == {"p": 0, "r": 0}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_addresses_are_not_broadcast(spark):
    rows = spark.createDataFrame([("p", 1, 1, "12 rue de la Paix 75002 Paris"), ("p", 2, 2, "12 rue de la Paix")], "project_id string, document_id long, ordinal long, value string")
    found = answers.project_location(rows)
    assert "Broadcast" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("p", "12 rue de la Paix 75002 Paris")]


def test_parts_of_names_are_not_broadcast(names):
    assert "Broadcast" not in _plan(companies.best_matches(*names))
