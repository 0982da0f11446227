"""The pipeline's stages on the given tables, each against a plain version of what it decides."""

from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from cadaster.llm import line_dedup, packing
from cadaster.llm.shared import saved
from tests.llm import plain


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents, and what each stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(saved(f(spark, out[-1], sf_dir), name.replace(" ", "-")))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_quality(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good, bad = (ids(stages[0].join(labels.where(F.col("quality") == y), "doc_id")) for y in (1, 0))
    kept = ids(stages[1])
    assert len(good & kept) >= 0.95 * len(good) and len(bad - kept) >= 0.6 * len(bad)
    same = texts(stages[0])
    assert all(t == same[i] for i, t in texts(stages[1]).items())


def test_lines(stages):
    want = plain.kept_lines(texts(stages[1]), line_dedup.MIN_WORDS)
    was = texts(stages[1])
    kept = {i: "\n".join(left) for i, (n, left) in want.items() if n == 0 or any(plain.words(x) for x in left)}
    got = stages[2].collect()
    assert {r.doc_id: r.text or "" for r in got} == kept
    assert all(r.n_chars == len(r.text) for r in got if r.text != was[r.doc_id])


def test_near_copies(stages):
    want = plain.components(texts(stages[2]), 5, Fraction(80, 100))
    assert ids(stages[3]) == {i for i, (_, root) in want.items() if i == root}


def test_benchmark(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain.contamination(texts(stages[3]), items)
    assert ids(stages[4]) == {i for i, (w, hit, _) in want.items() if not plain.is_contaminated(w, hit)}


def test_packing(stages):
    """One group holds all pieces here, so the plain best fit gives the same bins."""
    longest = max(packing.CAPACITIES)
    pieces = [(min(longest, n - at), i, at) for i, n in ((i, len(plain.words(t))) for i, t in texts(stages[4]).items()) for at in range(0, max(n, 1), longest)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    bins = plain.best_fit([n for n, _, _ in pieces if n], packing.CAPACITIES, packing.OVERHEAD)
    want = Counter((i, at, n, f"0-{b}", offset, capacity) for (n, i, at), (b, offset, capacity) in zip((p for p in pieces if p[0]), bins, strict=True))
    want += Counter((i, at, 0, None, None, None) for n, i, at in pieces if not n)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.bin_id, r.offset, r.capacity) for r in stages[5].collect()) == want


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()


def test_odd_tables(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, ties, columns with the operators' names, and no rows, at every stage."""
    line = "one two three four five six seven eight nine ten"
    rows = [(None, f"{line}\nnull id"), (1, None), (2, ""), (3, " \n "), (4, line), (5, f"{line}\nand more of it here"), (5, f"{line}\nand more of it here"), (6, "word " * 60_000), (7, "a b c d e f g"), (8, "a b c d e f g")]
    clash = ["score", "n_lines", "n_removed", "component_id", "n_shingles", "contamination", "rules", "bin_id", "n", "h", "at", "x", "__gone_by"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.lit(-1), **{c: F.lit(f"user {c}") for c in clash}})
    named = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
    for name in list(named)[:-1]:
        out = named[name](spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert all(r[c] == f"user {c}" for r in out.collect() for c in clash), name
    left = sorted(((r.doc_id, r.text, r.n_chars) for r in named["line dedup"](spark, docs, sf_dir).where("doc_id IS NULL OR doc_id <> 6").collect()), key=str)
    more = "and more of it here"
    assert left == sorted([(None, f"{line}\nnull id", -1), (1, None, -1), (2, "", -1), (3, " \n ", -1), (4, line, -1), (5, more, len(more)), (5, more, len(more)), (7, "a b c d e f g", -1)], key=str)
    kept = Counter(r.doc_id for r in named["n-gram Jaccard join"](spark, docs, sf_dir).collect())
    assert kept == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1}
    assert named["benchmark decontamination"](spark, docs, sf_dir).count() == len(rows)
    packed = named["best-fit packing"](spark, docs, sf_dir)
    assert packed.where("n_tokens = 0").count() == 3 and packed.agg(F.sum("n_tokens")).first()[0] == sum(len((t or "").split()) for _, t in rows)
