"""Operators on vectors and on bytes (11 to 13) against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaster.llm import hard_negatives, queries, suffix_dedup, whitening
from tests.llm.test_operators import SCHEMA, hash_of

ROWS = "vec_id long, embedding array<float>, label int, n long, x string, score double"


def table(spark, rows):
    """Rows of (vec_id, vector, label) with columns whose names operators use."""
    return spark.createDataFrame([(i, v, c, 1, "x", 0.5) for i, v, c in rows], ROWS).repartition(5)


# --- whitening ---------------------------------------------------------------------------------------


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


@pytest.mark.parametrize(
    "x",
    [
        np.floor(8 * np.random.default_rng(1).normal(size=(300, 24))) + 1e6,
        np.floor(8 * np.random.default_rng(2).normal(size=(9, 24))) + 1e6,
        np.tile(np.eye(6), (4, 1)) * 7,
        np.c_[np.arange(20.0), np.arange(20.0) * 2, np.ones(20)],
        np.ones((5, 3)),
    ],
    ids=["full", "fewer rows than dimensions", "equal eigenvalues", "dependent", "equal"],
)
def test_rank_one_updates_and_combination(x):
    d = x.shape[1]
    a, b = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
    for i, row in enumerate(x):
        (a if i % 3 else b).add(row)
    a.combine(b)
    c = scatter(x)
    size = max(np.abs(c).max(), 1)
    assert a.n == len(x) and np.allclose(a.mean, x.mean(axis=0))
    assert np.abs((a.vectors * a.values) @ a.vectors.T - c).max() < 1e-9 * size
    assert np.abs(a.vectors.T @ a.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(a.values - np.linalg.eigvalsh(c)).max() < 1e-9 * size


def check_whitened(got, rows, components=16):
    """rows: (vec_id, vector) that take part."""
    x = {i: [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for i, v in rows}
    fit = [list(v) for v in {tuple(v) for v in x.values()}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(sums))
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in rows for c in range(1, k + 1))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened or 0)):
        away = [n * a - s for a, s in zip(x[r.vec_id], sums, strict=True)]
        assert r.n == n and r.deviation == sum(a * a for a in away)
        e = values[r.component - 1]
        if e <= 1e-9 * values[0]:
            assert r.whitened is None
            continue
        want = float(np.array(away) / n @ vectors[:, r.component - 1]) / np.sqrt(e)
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert abs(r.whitened - sign * want) < 1e-7 and abs(r.explained - e / values.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 3, 20)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(300 + i, rows[5][1]) for i in range(30)]
    odd = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [1.0] * 7), (905, []), (906, [1e30] * 20)]
    got = whitening.whitened(table(spark, [(i, v, 0) for i, v in rows + odd])).collect()
    check_whitened(got, rows)


def test_whitening_without_variance(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(20)]
    check_whitened(whitening.whitened(table(spark, [(i, v, 0) for i, v in rows])).collect(), rows)
    (one,) = {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whitened(table(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()}
    assert one == (1, 0, None, None, None)
    assert whitening.whitened(table(spark, [])).collect() == []


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in queries.read(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    check_whitened(queries.op11_whitening(spark, sf_dir).collect(), rows)


def test_deviation_beyond_a_long():
    rows, sums = np.array([[1 << 39, 0], [0, 0]]), np.array([1 << 39, 0], dtype=object)
    assert whitening.deviations(rows, 2, sums) == [None, None]
    assert whitening.deviations(rows // (1 << 10), 2, sums // (1 << 10)) == [1 << 58, 1 << 58]
    assert whitening.centred(rows, 2, sums).tolist() == [[float(1 << 38), 0.0], [-float(1 << 38), 0.0]]


# --- suffixes ----------------------------------------------------------------------------------------


def removed(texts):
    """Which bytes of each text go, from all windows."""
    times = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if times[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append(bytes(gone))
    return out


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 3, 5, 8):
        pieces = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        shared = [[0, *(common(a, b) for a, b in zip(p, p[1:], strict=False))] for p in pieces]
        every = [s for p in pieces for s in p]
        order, prefixes = suffix_dedup.merge(pieces, shared)
        merged = [every[i] for i in order]
        assert sorted(order) == list(range(len(every))) and merged == sorted(every)
        assert prefixes == [0, *(common(a, b) for a, b in zip(merged, merged[1:], strict=False))]


@pytest.mark.parametrize("run, hot", [(1 << 16, 1 << 15), (40, 3)])
def test_suffixes_brute_force(spark, run, hot):
    rng = random.Random(3)
    texts = {}
    for kind, letters in enumerate(("ab", "abcdefgh \n", "éß€a", "a")):
        base = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 150, 199, 200, 201, 260, 400, 900)]
        for i in range(14):
            t = list("".join(rng.sample(base, rng.randint(1, 3))))
            for _ in range(rng.randint(0, 3) if t else 0):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["y", "z"]])
            texts[100 * kind + i] = "".join(t)
    texts |= {900: None, 901: "", 902: "long and longer, " * 30_000 + "end", 903: "q" * 199, 904: "q" * 150 + "r" * 100}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    got = {r.doc_id: r for r in suffix_dedup.digest(suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), run=run, hot=hot)).collect()}
    raws = {i: (t or "").encode() for i, t in texts.items()}
    for (i, raw), gone in zip(raws.items(), removed(list(raws.values())), strict=True):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for a, b in zip(b"\0" + gone, gone, strict=False) if b and not a)
        r = got.pop(i)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), spans), i
        assert r.kept_sha256 == __import__("hashlib").sha256(kept).hexdigest()
    assert not got


def test_suffixes_of_repeated_and_empty_tables(spark):
    a, b = "one text of its own " * 3 + "x" * 300, "".join(chr(97 + i * i % 23) for i in range(500))
    rows = [(1, b, "en", "s", 1), (1, b, "en", "s", 1), (None, b[:250], "en", "s", 1), (2, a[:60], "en", "s", 1), (None, None, "en", "s", 1)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.spans) for r in suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted((i or 0, n, gone) for i, n, gone, _ in got) == [(0, 0, 0), (0, 250, 250), (1, 500, 500), (1, 500, 500), (2, 60, 0)]
    assert suffix_dedup.digest(suffix_dedup.dedup(spark.createDataFrame([], SCHEMA))).collect() == []
    assert hash_of("")


# --- hard negatives ----------------------------------------------------------------------------------


def test_hilbert_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = hard_negatives.hilbert_keys(cells, bits)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        assert len(set(keys)) == len(keys) and (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_bound_scores():
    rng = np.random.default_rng(3)
    x, anchors = rng.integers(-50, 50, size=(40, 6)), rng.integers(-50, 50, size=(9, 6)).astype(float)
    low, high = hard_negatives.ZoneMaps(np.zeros(1), x.min(axis=0)[None].astype(float), x.max(axis=0)[None].astype(float), np.array([[0, 1]])).bounds(anchors)
    scores = anchors @ x.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= high[:, 0]).all()


def mined(rows, k=5):
    """From all pairs."""
    x = {(i, c, tuple(int(np.floor(256 * float(np.float32(e)))) for e in v)) for i, v, c in rows}
    out = set()
    for a, label, v in x:
        if a % 100:
            continue
        score = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, c) for i, c, w in x if i != a)
        for p, positive, _ in [s for s in score if s[2] == label][:k]:
            fits = [s for s in score if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out |= {(a, positive, n + 1, i, -p, -s) for n, (s, i, _) in enumerate(fits)}
    return out


@pytest.mark.parametrize("block, piece, seeds", [(4096, 1024, 2), (60, 16, 1)])
def test_hard_negatives_brute_force(spark, block, piece, seeds):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(10 * i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(500)]
    rows += [(7000 + i, rows[3][1], i % 3) for i in range(100)] + [(8000, [0.0] * 8, 1), (8100, [-5.0] * 8, 9)]
    odd = [(8200, None, 1), (8201, [None] * 8, 1), (8202, [float("nan")] * 8, 1), (8203, [1.0] * 8, None), (8204, [1.0] * 5, 1), (8205, [1e30] * 8, 1), (None, [1.0] * 8, 1), (8300, [], 1)]
    some = table(spark, rows + rows[:20] + odd)
    got = hard_negatives.mine(some, F.col("vec_id") % 100 == 0, block=block, piece=piece, seeds=seeds).collect()
    assert Counter(tuple(r) for r in got) == Counter(mined(rows))


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(table(spark, []), F.lit(True)).collect() == []
    assert hard_negatives.mine(table(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]), F.col("vec_id") % 100 == 0).collect() == []
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.1, 0.0], 2)]
    assert {tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") % 100 == 0).collect()} == {(100, 1, 1, 2, 65536, 58880)}


def test_blocks_that_cannot_help_are_not_read(spark):
    """Of two far groups an anchor's windows need its own only."""
    rng = np.random.default_rng(6)
    rows = [(i, ((1 if i % 2 else -1) * (np.ones(4) + 0.05 * rng.normal(size=4))).astype(np.float32).tolist(), i % 3) for i in range(400)]
    some = table(spark, rows).select("vec_id", F.col("label").cast("long").alias("label"), hard_negatives.whole(F.col("embedding")).alias("x"), F.lit(False).alias("anchor"))
    maps = hard_negatives.zone_maps(hard_negatives.layout(some, 4, 50, 16), 4)
    upper = maps.bounds(np.full((1, 4), 256.0))[1][0]
    assert len(upper) > 4 and 0.3 < (upper > 0).mean() < 0.8
