"""Queries against their SQL on keys and names that only larger tables have."""

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cadaster.functions import numbers
from cadaster.operators import comparables, companies, grids
from tests.conftest import rows_of


@pytest.fixture
def agrees(spark, tmp_path):
    """Checks a query's rows against its SQL over one table given as SQL."""

    def check(query, name, sql):
        con = duckdb.connect()
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        got, expected = __spark_entry__.QUERIES[query](spark, str(tmp_path)).toPandas(), con.sql(__spark_entry__.SQL[query]).df()
        assert rows_of(got, sorted(got.columns)) == rows_of(expected, sorted(got.columns))
        return got

    return check


def test_catalogue_order_of_equal_names_and_long_codes(agrees):
    got = agrees("o3_catalogue_order", "supplier", "SELECT i * 7 + 2148 AS s_suppkey, 'Supplier ' || (i % 3) AS s_name, 1::INT AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM range(200) t(i)")
    assert (got.department == "2B").any()


def test_replies_with_totals(agrees):
    """Prices from 50 000 are totals, which say nothing without an area; a price below them counts, if there is one."""
    got = agrees("x2_price_replies", "orders", "SELECT i AS o_orderkey, i * 997 AS o_custkey, 'O' AS o_orderstatus, 1.0::DOUBLE AS o_totalprice, TIMESTAMP '1997-01-01' AS o_orderdate, 'x' AS o_orderpriority FROM range(120) t(i)")
    assert (got[got.kind == "high"].price == 800).any() and got.price.max() < 50_000


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """What follows the join of subjects and sales is computed where the pairs are; subjects alike are asked once, each gets its rows."""
    subject = "SELECT id AS subject_id, 48.868D AS lat, 2.331D + (id % 3) AS lon, CASE WHEN id >= 0 THEN 'maison' END AS property_type, 50.0D AS living_area_sqm, 2 AS rooms, 9.0D AS land_area_sqm, 'Rue A' AS street_name, CASE WHEN id % 2 = 0 THEN 500 ELSE 5000 END AS search_radius_m, 1996 AS min_year, date'1998-09-02' AS valuation_date FROM range(12)"
    sale = "SELECT 1000.0D + id AS total_price, 10.0D AS living_area, 2 AS rooms, date'1998-01-01' AS sale_date, CASE WHEN id >= 0 THEN 'maison' END AS property_type, 'Rue A' AS street, cast(id AS int) AS number, 48.84D + id / 1000 AS lat, 2.331D + (id % 7) / 1000 AS lon, 9.0D AS land_area FROM range(60)"
    monkeypatch.setattr(comparables, "SALES_PER_TASK", 20)
    subjects, sales = spark.sql(subject), spark.sql(sale)
    rows = comparables.compare(subjects, sales)
    assert str(rows._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning(home") == 2
    plain = {tuple(r) for r in comparables.statistics(rows).collect()}
    alike = {tuple(r) for r in comparables.for_alike(subjects, lambda s: comparables.statistics(comparables.compare(s, sales))).collect()}
    assert plain == alike and {r[0] for r in plain} == {0, 3, 6, 9}
    box = [(48.868, 2.331, r / 111_320, r / (111_320 * math.cos(math.radians(48.868)))) for r in (500, 5000)]
    expected = [sum(abs(48.84 + i / 1000 - y) <= dy and abs(2.331 + (i % 7) / 1000 - x) <= dx for i in range(60)) for y, x, dy, dx in box]
    assert {r[0]: r[1] for r in plain} == {0: expected[0], 6: expected[0], 3: expected[1], 9: expected[1]}


def test_pairs_for_subjects_alike_are_not_shuffled(spark, sf_dir, monkeypatch):
    """Sales are shuffled once, their pairs never, where each of the subjects alike gets all pairs; ids, missing values and sales of nobody's days included."""
    monkeypatch.setattr(comparables, "SALES_PER_TASK", 20)
    keys = _exchanges(__spark_entry__.QUERIES["p17_display"](spark, sf_dir))
    assert [k for k in keys if "first" in k or k.startswith("cast(")] == [] and any(k.startswith("home, property_type, ") for k in keys)
    subjects = spark.sql("SELECT 100 + id AS subject_id, CASE WHEN id <> 11 THEN 48.868D END AS lat, 2.331D + (id % 3) / 500 AS lon, CASE WHEN id <> 10 THEN 'maison' END AS property_type, 50.0D AS living_area_sqm, 2 AS rooms, CASE WHEN id % 2 = 0 THEN 9.0D END AS land_area_sqm, 'Rue A' AS street_name, CASE WHEN id % 2 = 0 THEN 500 ELSE 5000 END AS search_radius_m, CASE WHEN id % 3 = 0 THEN 1996 END AS min_year, date'1998-09-02' AS valuation_date FROM range(24)")
    sales = spark.sql("SELECT 1000.0D + id AS total_price, 10.0D AS living_area, 2 AS rooms, date_add(date'1993-01-01', cast(id * 40 AS int)) AS sale_date, CASE WHEN id >= 0 THEN 'maison' END AS property_type, 'Rue A' AS street, cast(id % 9 AS int) AS number, 48.86D + id / 9000 AS lat, 2.331D + (id % 7) / 1000 AS lon, 9.0D AS land_area FROM range(90)")
    plain = comparables.compare(subjects, sales).drop("home", "property_type")
    each = comparables.rows_for_alike(subjects, sales, comparables.compare)
    assert sorted(plain.columns) == sorted(each.columns)
    expected, got = (Counter(map(tuple, x.select(*sorted(plain.columns)).collect())) for x in (plain, each))
    assert expected == got and len({r.subject_id for r in each.select("subject_id").collect()}) == 22 and each.where("sale_date < '1996-01-01' OR sale_date > '1998-09-02'").isEmpty()


def test_sales_at_one_place_meet_a_place_once(spark, tmp_path, monkeypatch):
    """Sales and subjects of places that repeat are as many pairs as there are places, with the counts and distances of all of them."""
    con, pairs, join = duckdb.connect(), [], comparables.box_join
    for name, sql in {
        "customer": "SELECT i // 40 + 7 + i % 40 * 100000 AS c_custkey FROM range(80) t(i)",
        "lineitem": "SELECT 1000.0::DOUBLE + i AS l_extendedprice, 10.0::DOUBLE AS l_quantity, i % 10 + i % 9 * 100000 AS l_partkey, 7 + i % 2 + i % 7 * 100 AS l_suppkey, TIMESTAMP '1998-01-01' AS l_shipdate FROM range(1260) t(i)",
    }.items():
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")

    def counted(*tables, **options):
        found = join(*tables, **options)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(comparables, "box_join", counted)
    got, expected = __spark_entry__.QUERIES["j2_radius_join"](spark, str(tmp_path)).toPandas(), con.sql(__spark_entry__.SQL["j2_radius_join"]).df()
    assert rows_of(got, ["subject_id", "n", "metres"]) == rows_of(expected, ["subject_id", "n", "metres"]) and len(got) == 80 and got.n.sum() == 80 * 630
    assert pairs == [10]


def test_amounts_of_all_sizes_in_french(spark):
    """Whole cents below a million are written by another way than the rest."""
    texts = {0.0: "0", 0.05: "0,05", 0.5: "0,5", 0.29: "0,29", 1.005: "1,01", 999.99: "999,99", 999.995: "1 000", 1000.0: "1 000", 1005.2: "1 005,2", 999999.99: "999 999,99", 999999.995: "1 000 000", 1234567.8: "1 234 567,8", -3.25: "-3,25", 1e12: "1 000 000 000 000"}
    got = spark.createDataFrame([(v,) for v in (*texts, None)], "v double").select("v", numbers.french(F.col("v")).alias("text")).collect()
    assert {r.v: r.text for r in got} == {**texts, None: None}


def test_answers_are_written_in_as_many_folders_at_every_size(agrees, spark, tmp_path):
    """A folder holds the answers of many projects: commits and listings do not grow with the projects."""
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("cadaster-results-*"))
    agrees("src9_result_files", "events", "SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i AS user_id, 'click' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(900) t(i)")
    (made,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("cadaster-results-*")) - before
    assert len(list((made / "answers").glob("*=*"))) <= 64 and len(list((made / "answers").rglob("*.json"))) <= 64


def _relations(spark):
    """Companies whose people hold several each, with ceased mandates, companies as representatives and several labels of one person."""
    reps = spark.sql("SELECT cast(pmod(hash(id), 17) AS string) AS siren, id AS ordinal, CASE WHEN id % 7 > 0 THEN concat('p', pmod(hash(id, 1), 40)) END AS person_id, CASE WHEN id % 7 = 0 THEN cast(pmod(hash(id, 2), 17) AS string) END AS company, element_at(array('Gérant', 'Président', NULL), cast(id % 3 + 1 AS int)) AS qualite, id % 4 = 0 AS entreprise_cessee FROM range(160)")
    roots = reps.select("siren").distinct()
    return roots, reps, reps.where("person_id IS NOT NULL"), roots.selectExpr("siren", "1 AS ordinal", "cast(siren + 2 AS string) AS predecessor")


def _exchanges(rows):
    """The keys of a plan's exchanges."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", rows._jdf.queryExecution().executedPlan().toString()))


def test_nodes_of_a_network_are_not_shuffled(spark, monkeypatch):
    """Companies come to the root with their people in arrays; each node is told there. Its rank is that of the first visit, step by step."""
    monkeypatch.setattr(companies, "REPRESENTATIVES_PER_TASK", 30)
    relations = _relations(spark)
    nodes, _ = companies.network(*relations)
    assert not [k for k in _exchanges(nodes) if "node" in k] and "root, 6" in _exchanges(nodes)
    seen = companies.visits(*relations).orderBy("root", "visit").collect()
    people, expected = defaultdict(set), {}
    for r in relations[1].where("person_id IS NOT NULL").collect():
        people[r.siren].add(r.person_id)
    for root, siren, rank in [(r.siren, r.siren, 0) for r in relations[0].collect()] + [(r.root, r.siren, r["rank"]) for r in seen]:
        for node, of in ((f"soc_{siren}", rank), *((p, rank + 1) for p in people[siren])):
            expected.setdefault((root, node), of)
    got = {(r.root, r.node): r["rank"] for r in nodes.collect()}
    assert got == expected and nodes.count() == len(got) and set(got.values()) == {0, 1, 2, 3}


def test_edges_of_a_network_are_cleaned_where_they_are(spark, monkeypatch):
    """As cleaning all edges by all nodes gives, at every bound; nothing is shuffled by the ends of edges."""
    monkeypatch.setattr(companies, "REPRESENTATIVES_PER_TASK", 30)
    relations = _relations(spark)
    nodes, edges = companies.network(*relations)
    for below in (1, 2, 3, 4):
        clean = companies.clean_network(*relations, below=below)
        plain = companies.clean_edges(edges, nodes.where(F.col("rank") < below))
        assert sorted(map(tuple, clean.collect())) == sorted(map(tuple, plain.select(clean.columns).collect()))
    assert not [k for k in _exchanges(clean) if "src" in k or "dst" in k]


def test_cells_of_account_grids_are_read_once(spark):
    """However many expressions ask for it: the plan has one reading of a cell's blanks, and one folding of a label."""
    rows = [["Poste", "2021", "2020"], ["\u00a0Terrains ", "", None], ["- nus", "( 1\u00a0000,5)", "-3"], ["12 m", "1 2", "(4"], ["Exercice du", "au 31", ""], ["", "\u202f7", "x"]]
    got = grids.logical_rows(spark.createDataFrame([(1, rows)], "doc_id long, cells array<array<string>>"))
    assert [(r.label, r.n, r.n1) for r in got.collect()] == [("Poste", 2021.0, 2020.0), ("Terrains - nus", None, -3.0), ("12 m", 12.0, 4.0), ("Exercice du", 7.0, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\p{Mn}+") == 1 and plan.count(f"{numbers.SPACES}+, ") == 1
