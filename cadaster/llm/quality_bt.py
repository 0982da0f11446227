"""Operator 2: quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Preference pairs set a document
labelled 1 over one labelled 0; the chance that the first wins is the logistic function of the
difference of their strengths, so the weights come from a logistic loss on feature differences. The
cut between good and bad is the quantile of the strengths at the share of rows labelled 0, among all
rows that may be learned from; of equal strengths those labelled 0 come first. A score is the logistic function of the
strength, moved so that the cut scores CUT.

Weights and cut are fitted on every labelled row that may be learned from, and every document is scored over its whole
text. By MOST a caller may bound the rows of a label; those taken then count as many as they stand for.

1. Features are found where the texts are; they, not texts, are shuffled to their labels.
2. Rows are ranked by a sort. Pair k, of PAIRS_PER_ROW for each row of the commoner label, joins two ranks; a row in
   many pairs (its label is rare) is copied, so that no key has more than PER_COPY of them.
3. Each Newton step sums gradient and Hessian of all pairs over partitions; the driver sees those sums, of 21 and
   21 x 21 numbers.
4. The cut is found by counting the strengths in SLOTS intervals, then in those of the interval that it is in, until
   that has one value: exact, and the driver sees SLOTS counts at a time.

Edge cases: null and empty texts have the features of no words; without rows of both labels every
score is 0.5; repeated rows are each learned from and scored, equal texts alike, and equal scores are on the same side of the cut; a null doc_id is not held
out, has no label, and is scored; other columns pass through `score` untouched, an older column named score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.llm.labelled import sample
from cadaster.llm.shared import PER_COPY, by_merge, map_texts, passing, saved

#: Bounds on the rows of each label that are learned from; None: all of them.
MOST: dict[int, int | None] = {0: None, 1: None}
PAIRS_PER_ROW = 4
#: Intervals that strengths are counted in at a time.
SLOTS = 1024
CUT = 0.3
L2 = 1.0

UPPER, DIGITS, SYMBOLS, CODE = bytes(range(65, 91)), b"0123456789", b"#*$%&<>~^", b"{}[]=;\\_"
HIGH = bytes(range(0x80, 0x100))
N_FEATURES = 21


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def features(raw: bytes | None) -> list[float]:
    """Shape of a text: how long, how varied, how much of it is not prose. No identity, language or source."""
    raw = raw or b""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    kinds = set(words)
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    tail = sum(w[-1] not in b".,;:?" and not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or 97 <= w[-1] <= 122 or w[-1] >= 128) for w in words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    part = len(kinds) / n
    return [
        np.log1p(len(words)),
        float(len(words) < 20),
        size / n,
        float(lengths.std()) if len(words) else 0.0,
        _count(raw, UPPER) / size,
        _count(raw, DIGITS) / size,
        _count(raw, SYMBOLS) / n,
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        _count(raw, CODE) / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        repeats / n,
        part,
        part * np.log1p(len(words)),
        tail / n,
        np.log1p(n_lines) / np.log1p(n),
        1 - len(set(lines)) / n_lines,
        _count(raw, HIGH) / size,
        raw.count(b"http") / n,
        float(((lengths <= 2) | (lengths >= 24)).mean()) if len(words) else 0.0,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        # not a matrix product: a row's sum must not depend on the rows beside it
        return (self.scaled(x) * self.weights).sum(axis=-1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + np.log(CUT / (1 - CUT)), -40, 40)))


def _matrix(column) -> np.ndarray:
    """An Arrow column of packed features, a row each."""
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, size: int, of) -> np.ndarray:
    """The sum of of(matrix), an array of that size, over all rows' only column: one array a partition reaches the driver."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            total += of(_matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["no", "total"])

    total = np.zeros(size)
    for r in sorted(rows.mapInArrow(run, "no long, total binary").collect()):
        total += np.frombuffer(r.total)
    return total


def _ranked(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """y, rank and x, saved, and the numbers of rows labelled 0 and 1. Ranks are each label's own, from 0, by hash and doc_id."""
    # rows equal but for their number are the same to learn from; the number lets a sort deal them to several tasks
    ordered = rows.withColumn("number", F.monotonically_increasing_id()).orderBy("y", "h", "doc_id", "x", "number")
    ordered = saved(ordered.select("y", "x", F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33).alias("part")
    sizes = sorted(ordered.groupBy(part).agg(F.count("*"), F.count_if(F.col("y") == 0)).collect())
    starts = np.cumsum([0, *(n for _, n, _ in sizes)]).tolist()
    n, bad = starts.pop(), sum(b for *_, b in sizes)
    first = rows.sparkSession.createDataFrame([(p, s) for (p, *_), s in zip(sizes, starts, strict=True)], "part long, first long")
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) - F.when(F.col("y") == 1, bad).otherwise(0)
    # a row for each partition of the sort
    return ordered.withColumn("part", part).join(F.broadcast(first), "part").select("y", rank.alias("rank"), "x"), bad, n - bad


def _meet(pairs: DataFrame, rows: DataFrame, key: str, each: float) -> DataFrame:
    """pairs with the row of their key, which `each` of them have on average."""
    copies = int(-(-each // PER_COPY))
    dealt = pairs.withColumn("copy", F.pmod(F.hash("k"), F.lit(copies)))
    return by_merge(dealt, rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), [key, "copy"]).drop("copy")


def _pairs(ranked: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """The features of each pair's good and bad row; every row of the commoner label is in PAIRS_PER_ROW pairs or about as many."""
    n = PAIRS_PER_ROW * max(n_good, n_bad)
    # ranks come in hash order; each pass over the shorter side is shifted, so pairs differ
    bad = f"(id + id div {n_good} * 7 + id div {n_bad}) % {n_bad}"
    pairs = ranked.sparkSession.range(n).selectExpr("id AS k", f"id % {n_good} AS good", f"{bad} AS bad")
    for key, y, of in (("good", 1, n_good), ("bad", 0, n_bad)):
        pairs = _meet(pairs, ranked.where(F.col("y") == y).select(F.col("rank").alias(key), F.col("x").alias(f"x_{key}")), key, n / of)
    return pairs.select("x_good", "x_bad")


def fit_pairs(rows: DataFrame, share: float) -> Model | None:
    """The Bradley-Terry weights, by Newton steps on the loss of all pairs, and the cut.

    rows: doc_id, y, h and x, the features packed as doubles. share: of rows labelled 0.
    """
    import pyarrow as pa

    ranked, n_bad, n_good = _ranked(rows)
    if not n_bad or not n_good:
        return None
    mean = _summed(ranked.select("x"), N_FEATURES, lambda x: x.sum(axis=0)) / (n_bad + n_good)
    scale = np.sqrt(_summed(ranked.select("x"), N_FEATURES, lambda x: ((x - mean) ** 2).sum(axis=0)) / (n_bad + n_good)) + 1e-9
    start = Model(mean, scale, np.zeros(N_FEATURES), 0.0)

    def differences(batches):
        for b in batches:
            d = start.scaled(_matrix(b.column(0))) - start.scaled(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in d], pa.binary())], names=["d"])

    d = saved(_pairs(ranked, n_bad, n_good).mapInArrow(differences, "d binary"), "pairs")
    w = np.zeros(N_FEATURES)
    for _ in range(25):

        def slopes(d, w=w):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
            return np.concatenate((d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()))

        found = _summed(d, N_FEATURES * (N_FEATURES + 1), slopes)
        step = np.linalg.solve(found[N_FEATURES:].reshape(N_FEATURES, N_FEATURES) + L2 * np.eye(N_FEATURES), found[:N_FEATURES] - L2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(mean, scale, w, 0.0)

    def strengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.strength(_matrix(b.column(1))))], names=["y", "s"])

    found = ranked.select(F.col("y").cast("int").alias("y"), "x").mapInArrow(strengths, "y int, s double")
    found = saved(found.groupBy("s").agg(F.count_if(F.col("y") == 0).alias("n_bad"), F.count_if(F.col("y") == 1).alias("n_good")), "strengths")
    return replace(model, cut=cut_of(found, share / n_bad, (1 - share) / n_good, share))


def quantile(strength: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The point below which `share` of the weights (one in all) lies: between the two strengths at it."""
    order = np.argsort(strength, kind="stable")
    at = int(np.searchsorted(weight[order].cumsum(), share - 1e-9))
    return float(strength[order][max(0, at - 1) : at + 1].mean())


def cut_of(strengths: DataFrame, bad: float, good: float, share: float) -> float:
    """The quantile at `share` of strengths: s, n_bad and n_good, each s once; a row labelled 0 weighs `bad`, one labelled 1 `good`."""
    s = F.col("s")
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    n_bad, n_good, before = 0, 0, None
    while True:
        slot = F.floor((s - low) / (high - low) * (SLOTS - 1)) if low < high else F.lit(0)
        slots = strengths.where(s.between(low, high)).groupBy(slot.alias("slot")).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("n_bad").alias("n_bad"), F.sum("n_good").alias("n_good"))
        for r in sorted(slots.collect()):
            if (n_bad + r.n_bad) * bad + (n_good + r.n_good) * good >= share - 1e-9:
                break
            n_bad, n_good, before = n_bad + r.n_bad, n_good + r.n_good, r.high
        low, high = r.low, r.high
        if low == high:
            break
    # what is before, the first row of this strength, its others
    first = bad if r.n_bad else good
    weight = np.array([n_bad * bad + n_good * good, first, r.n_bad * bad + r.n_good * good - first])
    return quantile(np.array([low if before is None else before, low, low]), weight, share)


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Model | None:
    """keep: which doc_ids may be learned from."""
    share = labels.where(F.col("quality").isin(0, 1) & keep).agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    if share is None:
        return None

    def per_text():
        return lambda raw: (np.array(features(raw)).tobytes(),)

    with passing([]):
        found = map_texts(docs.where(keep & F.col("doc_id").isNotNull()), ["doc_id"], "x binary", per_text)
        return fit_pairs(saved(sample(found, labels, "quality", keep, MOST), "labelled"), share)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `score`, 0 to 1, over whole texts."""
    keep = [c for c in docs.columns if c != "score"]
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias("score"))

    def per_text():
        return lambda raw: (float(model.score(np.array(features(raw)))),)

    return map_texts(docs, keep, "score double", per_text)
