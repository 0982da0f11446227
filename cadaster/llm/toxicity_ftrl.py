"""Operator 5: toxicity by FTRL-proximal logistic regression.

Features are hashed into 2^BITS buckets: the words of a text in the lower half, its word pairs and
pairs that skip one or two words in the upper half, each present or not; pairs count PAIR_VALUE, as
there are many and most are seen once. The learner visits a bounded sample of labelled documents one by
one; each coordinate has its own learning rate, and the L1 term leaves most weights at nought, so
the fitted weights are a short list that is broadcast. Training is one task, as the method is
sequential, over a sample bounded in rows and in features (240 MB); rows past the second bound are
not learned from. Scoring reads every whole text in parallel.

Edge cases: null and empty texts have the intercept's score; without labelled rows every score is
0.5; repeated rows are each scored; a null doc_id is not held out; other columns pass through
`score` untouched, an older column named score is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from cadaster.llm.labelled import sample
from cadaster.llm.shared import map_texts
from cadaster.llm.text import ALNUM, LOWER, mix, spans, word_hashes

#: Bounds of the sample: rows of each label, and features that the learning task holds of them, in an order by hash.
MOST, MOST_FEATURES = {0: 6_000, 1: 5_000}, 60_000_000
BITS = 20
PASSES = 4
PAIR_VALUE = 0.1
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.1
THRESHOLD = 0.7


def buckets(raw: bytes | None) -> np.ndarray:
    """Buckets of a text's words, pairs and skipping pairs; may repeat."""
    if not raw:
        return np.empty(0, dtype=np.int64)
    words = word_hashes(*spans(raw.translate(LOWER), ALNUM))
    grams = [words]
    for gap in (1, 2, 3):
        if len(words) > gap:
            grams.append(mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15 + 2 * gap) + words[gap:]))
    half = np.uint64(65 - BITS)
    pairs = np.concatenate(grams[1:]) if len(grams) > 1 else np.empty(0, dtype=np.uint64)
    return np.concatenate((words >> half, (pairs >> half) + np.uint64(1 << BITS - 1))).astype(np.int64)


def values(at: np.ndarray) -> np.ndarray:
    """The value of a bucket's feature where it is present."""
    return np.where((at >= 1 << BITS - 1) & (at < 1 << BITS), PAIR_VALUE, 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal; the intercept is the last coordinate and is not shrunk."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, x = self.weights(at), values(at)
        g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> dict[int, float]:
    """The weights that are not nought; the intercept is at 2^BITS. keep: which doc_ids may be learned from."""
    import pyarrow as pa

    rows = sample(docs.select("doc_id", "text"), labels, "toxic", keep, MOST)

    def per_text():
        return lambda raw: (np.append(np.unique(buckets(raw)), 1 << BITS).astype(np.int32).tolist(),)

    def learn(batches):
        seen, held = [], 0
        for b in batches:
            for at, y in zip(b.column("at"), b.column("y").to_pylist(), strict=True):
                held += len(at)
                if held <= MOST_FEATURES:
                    seen.append((np.array(at.values), y))
        model = Ftrl()
        for _ in range(PASSES):
            for at, y in seen:
                model.learn(at, y)
        if seen:
            every = np.arange((1 << BITS) + 1)
            w = model.weights(every)
            yield pa.RecordBatch.from_arrays([pa.array(every[w != 0]), pa.array(w[w != 0])], names=["at", "w"])

    # buckets are found in parallel; the one task that learns reads the bounded sample's alone
    found = map_texts(rows, ["doc_id", "y", "h"], "at array<int>", per_text)
    learned = found.repartition(1).sortWithinPartitions("h", "doc_id").select("at", "y").mapInArrow(learn, "at long, w double")
    return {r.at: r.w for r in learned.collect()}


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """docs with `score`, 0 to 1, over whole texts."""
    keep = [c for c in docs.columns if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def per_text():
        w = np.zeros((1 << BITS) + 1)
        w[list(sent.value.keys())] = list(sent.value.values())

        def one(raw):
            at = buckets(raw)
            at = np.unique(at[w[at] != 0])
            return (float(1 / (1 + np.exp(-np.clip((w[at] * values(at)).sum() + w[-1], -35, 35)))),)

        return one

    return map_texts(docs, keep, "score double", per_text)
