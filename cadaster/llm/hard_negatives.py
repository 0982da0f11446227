"""Operator 13: hard negatives by windows of scores, from Hilbert-ordered blocks with zone maps.

For each anchor the best rows of its label are its positives, and for each positive the best rows of other labels
whose score is within a window below the positive's are its hard negatives. Scores are exact inner products of whole numbers.

1. Layout. Rows are laid out along a Hilbert curve over all dimensions (two bits each, cut at each dimension's mean
   and two thirds of its deviation to either side) and written as a Parquet table of blocks, one directory each, with the least and
   greatest value of every dimension: zone maps. A block is cut into pieces of PIECE rows with zone maps of their own.
2. Bounds. Interval arithmetic on a zone map bounds an anchor's scores in the block from both sides. Seeds: the SEEDS blocks
   of the highest upper bound give each anchor a score that its last positive reaches at least. Then it reads the
   blocks that can reach that score for its positives, and those that can meet one of its windows for its negatives.
   Only directories that some anchor reads are scanned; a block's pieces that cannot help are skipped.
3. Anchors that need a block meet its pieces in a join on the block (in as many parts as anchors ask for), and one
   matrix product scores them together. Each piece gives an anchor its few best; ranking over pieces limits before it shuffles.

There are at most ZONES / d blocks, so that all their zone maps are a few MB at any size and in any dimension; rows a block grow past that. In many
dimensions without structure bounds are wide and nearly all is read: then this is the block product of the anchors with all rows.

Edge cases: rows with a null id, label or vector, a null, non-finite or too large component (MOST: products must be exact), or
a vector of another length than most have (of equally many the longer) take no part. Equal rows count once; rows that share
an id only are candidates of their own, and as anchors are one anchor with all their candidates. Ties go by smaller id. Fewer
positives or negatives than asked for give all there are; an anchor without any gives no rows, and a positive of negative score has no
window. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadaster.llm.shared import by_merge, forget, passing, saved

#: Rows of a block, as long as all blocks have no more than ZONES dimensions together; rows of a piece; anchors that go together.
BLOCK, ZONES, PIECE, GROUP = 4096, 1 << 18, 1024, 256
#: Anchors of one part of a block's join.
PART = 1 << 14
SEEDS = 2
BITS = 2
#: Components are below this: products of vectors of up to 2^13 components are exact in doubles, and a hundred of them in longs.
MOST = 1 << 20
PAIR = "anchor_id long, score long, vec_id long"


def whole(vector: Column) -> Column:
    """floor(256 c) of each component; null where the vector takes no part."""
    good = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < MOST / 256))
    return F.when(good, F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("int")))


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place of each row of cells (below 2^bits in every dimension) along the Hilbert curve, as bytes that sort so."""
    x = cells.T.astype(np.uint8)
    top = 1 << (bits - 1)
    for bit in [top >> i for i in range(bits - 1)]:
        low = bit - 1
        for i in range(len(x)):
            set_ = x[i] & bit != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(set_, low, swap).astype(np.uint8)
            if i:
                x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], dtype=np.uint8)
    for bit in [top >> i for i in range(bits - 1)]:
        turn ^= np.where(x[-1] & bit, bit - 1, 0).astype(np.uint8)
    x ^= turn
    planes = np.concatenate([(x >> b) & 1 for b in range(bits - 1, -1, -1)])
    return [row.tobytes() for row in np.packbits(planes.T, axis=1)]


@dataclass
class ZoneMaps:
    """Of blocks or pieces: number, least and greatest of every dimension, of the labels."""

    block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    labels: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that rows of x can have with those of each zone."""
        plus, minus = np.maximum(x, 0.0), np.minimum(x, 0.0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T

    def of_label(self, labels: np.ndarray) -> np.ndarray:
        """Whether each zone can hold each label."""
        return (self.labels[:, 0] <= labels[:, None]) & (labels[:, None] <= self.labels[:, 1])


def _numbers(raw: bytes, kind: str, d: int = 1) -> np.ndarray:
    out = np.frombuffer(raw, dtype=kind)
    return out.reshape(-1, d) if d > 1 else out


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def layout(rows: DataFrame, d: int, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The saved table of blocks: block, low, high, labels_low, labels_high, ids, labels, x, anchors by piece."""
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    s = rows.select(Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col("x").cast("array<double>"))).alias("s")).first()["s"]
    count, mean = s["count"], np.array(s["mean"].toArray())
    cuts = np.stack([mean, mean - 0.6745 * s["std"].toArray(), mean + 0.6745 * s["std"].toArray()])
    cuts.sort(axis=0)
    n_blocks = int(max(1, min(ZONES // d, -(-count // block))))

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                x = _vectors(b.column(2))
                keys = hilbert_keys((x[None] > cuts[:, None]).sum(axis=0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=["vec_id", "label", "x", "anchor", "key"])

    def one(number, ids, labels, x, anchors):
        return (number, x.min(axis=0).astype("<i4").tobytes(), x.max(axis=0).astype("<i4").tobytes(), int(labels.min()), int(labels.max()), ids.tobytes(), labels.tobytes(), x.astype("<i4").tobytes(), anchors.astype(np.uint8).tobytes())

    schema = "block int, low binary, high binary, labels_low long, labels_high long, ids binary, labels binary, x binary, anchors binary"

    fields = [f.split() for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def pieces(batches):
        from pyspark import TaskContext

        number, held, last = TaskContext.get().partitionId(), [], None

        def cut(least):
            ids, labels, x, anchors = (np.concatenate(c) for c in zip(*held, strict=True))
            out = [one(number, *(c[at : at + piece] for c in (ids, labels, x, anchors))) for at in range(0, len(ids) - least + 1, piece) if len(ids) > at]
            done = min(len(ids), len(out) * piece)
            held[:] = [(ids[done:], labels[done:], x[done:], anchors[done:])] if done < len(ids) else []
            return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for b in batches:
            if not b.num_rows:
                continue
            ids, labels, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _vectors(b.column(2))
            anchors = b.column(3).to_numpy(zero_copy_only=False)
            # equal rows are neighbours
            all_ = np.concatenate((ids[:, None], labels[:, None], x), axis=1)
            before = np.concatenate(([all_[0] + 1 if last is None else last], all_[:-1]))
            new, last = (all_ != before).any(axis=1), all_[-1]
            held.append((ids[new], labels[new], x[new], anchors[new]))
            if sum(len(h[0]) for h in held) >= piece:
                yield cut(piece)
        if held and sum(len(h[0]) for h in held):
            yield cut(1)

    keys = rows.select("vec_id", "label", "x", "anchor").mapInArrow(keyed, "vec_id long, label long, x array<int>, anchor boolean, key binary")
    ordered = keys.repartitionByRange(n_blocks, "key", "vec_id", "label").sortWithinPartitions("key", "vec_id", "label", "x").drop("key")
    return saved(ordered.mapInArrow(pieces, schema), "blocks", "block")


def zone_maps(blocks: DataFrame, d: int) -> ZoneMaps:
    """Those of all blocks: each piece's, reduced by block in the executors."""
    import pandas as pd

    def reduce(key, part):
        low, high = (np.stack([_numbers(x, "<i4") for x in part[c]]) for c in ("low", "high"))
        return pd.DataFrame({"block": [key[0]], "low": [low.min(axis=0).tobytes()], "high": [high.max(axis=0).tobytes()], "labels_low": [part["labels_low"].min()], "labels_high": [part["labels_high"].max()]})

    found = blocks.select("block", "low", "high", "labels_low", "labels_high").groupBy("block").applyInPandas(reduce, "block int, low binary, high binary, labels_low long, labels_high long").collect()
    stack = lambda c: np.array([_numbers(r[c], "<i4") for r in found], dtype=float).reshape(len(found), d)
    return ZoneMaps(np.array([r["block"] for r in found], dtype=np.int32), stack("low"), stack("high"), np.array([(r["labels_low"], r["labels_high"]) for r in found], dtype=np.int64).reshape(-1, 2))


def read_anchors(blocks: DataFrame, d: int) -> DataFrame:
    """anchor_id, label, x of each anchor."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for ids, labels, x, anchors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                some = np.flatnonzero(_numbers(anchors, "u1"))
                if len(some):
                    vectors = np.frombuffer(x, dtype="<i4").reshape(-1, d)[some]
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(ids, "<i8")[some]), pa.array(_numbers(labels, "<i8")[some]), pa.array(list(vectors), pa.list_(pa.int32()))], names=["anchor_id", "label", "x"])

    return blocks.select("ids", "labels", "x", "anchors").mapInArrow(run, "anchor_id long, label long, x array<int>")


def meet(anchors: DataFrame, extra: str | None, blocks: DataFrame, maps: ZoneMaps, d: int, parts: int, wanted: Callable, score: Callable, schema: str) -> DataFrame:
    """What `score` finds where anchors meet the pieces of the blocks that they want.

    wanted(maps, vectors, labels, extras): a matrix, anchors by zones. score(scores, ids, labels, extras, ids of rows, labels of rows,
    matrix of wanted): columns. extra: a column of anchors, an array of longs, handed to both.
    """
    import pyarrow as pa

    def ask(batches):
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                part = b.slice(at, GROUP)
                ids, labels, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _vectors(part.column(2)).astype(float)
                extras = part.column(3).to_pylist()
                want = wanted(maps, x, labels, extras)
                for zone in np.flatnonzero(want.any(axis=0)).tolist():
                    some = np.flatnonzero(want[:, zone])
                    columns = [[int(maps.block[zone])], [int(ids[some[0]]) % parts], [ids[some].tobytes()], [labels[some].tobytes()], [x[some].astype("<i4").tobytes()]]
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([*columns, [[extras[i] for i in some.tolist()]]], kinds, strict=True)], names=["block", "part", "anchor_ids", "anchor_labels", "anchor_x", "extras"])

    asked = anchors.select("anchor_id", "label", "x", F.col(extra) if extra else F.lit(None).cast("array<bigint>").alias("none"))
    pairs = saved(asked.mapInArrow(ask, "block int, part int, anchor_ids binary, anchor_labels binary, anchor_x binary, extras array<array<bigint>>"), "asked")
    # block numbers, ZONES / d at most: directories that are scanned
    some = [r[0] for r in pairs.select("block").distinct().collect()]
    read = blocks.where(F.col("block").isin(some)) if some else blocks.where("false")
    read = read.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = b.to_pydict()
            for i in range(b.num_rows):
                ids, labels, x = _numbers(rows["anchor_ids"][i], "<i8"), _numbers(rows["anchor_labels"][i], "<i8"), np.frombuffer(rows["anchor_x"][i], dtype="<i4").reshape(-1, d).astype(float)
                zone = ZoneMaps(np.zeros(1, dtype=np.int32), *(np.frombuffer(rows[c][i], dtype="<i4").reshape(1, d).astype(float) for c in ("low", "high")), np.array([[rows["labels_low"][i], rows["labels_high"][i]]]))
                want = np.flatnonzero(wanted(zone, x, labels, rows["extras"][i], True)[:, 0])
                if not len(want):
                    continue
                others = np.frombuffer(rows["x"][i], dtype="<i4").reshape(-1, d).astype(float)
                scores = (x[want] @ others.T).astype(np.int64)
                found = score(scores, ids[want], labels[want], [rows["extras"][i][k] for k in want.tolist()], _numbers(rows["ids"][i], "<i8"), _numbers(rows["labels"][i], "<i8"))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=names)

    joined = by_merge(pairs, read, ["block", "part"]).select("anchor_ids", "anchor_labels", "anchor_x", "extras", "low", "high", "labels_low", "labels_high", "ids", "labels", "x")
    return joined.mapInArrow(run, schema)


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each owner's entries the first k by falling score and rising id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return order[rank < k]


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, block: int = BLOCK, piece: int = PIECE, seeds: int = SEEDS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: which rows are anchors. least: a negative's score is at least so many hundredths of the positive's, and no more than all of it.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    some = rows.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(F.col(vector)).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    some = some.where("vec_id is not null and label is not null and x is not null")
    lengths = some.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not lengths or not lengths[0]:
        return rows.sparkSession.createDataFrame([], out)
    d = lengths[0]
    keep: list[DataFrame] = []
    with passing(keep):
        blocks = layout(some.where(F.size("x") == d), d, block, piece)
        maps = zone_maps(blocks, d)
        anchors = saved(read_anchors(blocks, d), "anchors")
        parts = 1 + anchors.count() // PART

        def same_label(scores, ids, labels, extras, row_ids, row_labels):
            good = (row_labels == labels[:, None]) & (row_ids != ids[:, None])
            for i, e in enumerate(extras):
                if e:
                    good[i] &= scores[i] >= e[0]
            owner, other = np.nonzero(good)
            kept = best(owner, scores[owner, other], row_ids[other], positives)
            owner, other = owner[kept], other[kept]
            return ids[owner], scores[owner, other], row_ids[other]

        def highest(zones, x, labels, extras, in_piece=False):
            able = zones.of_label(labels)
            if in_piece:
                return able
            upper = np.where(able, zones.bounds(x)[1], -np.inf)
            n = min(seeds, upper.shape[1])
            return able & (upper >= np.partition(upper, -n, axis=1)[:, -n][:, None])

        seeded = _ranked(meet(anchors, None, blocks, maps, d, parts, highest, same_label, PAIR), ["anchor_id"], positives)
        # a score that as many rows of the label reach as there are to be positives
        floor = seeded.where(F.col("rank") == positives).select("anchor_id", F.array("score").alias("floor"))
        floored = saved(anchors.join(floor, "anchor_id", "left"), "floored")

        def reaching(zones, x, labels, extras, in_piece=False):
            reach = np.array([e[0] if e else -np.inf for e in extras])
            return zones.of_label(labels) & (zones.bounds(x)[1] >= reach[:, None])

        found = _ranked(meet(floored, "floor", blocks, maps, d, parts, reaching, same_label, PAIR), ["anchor_id"], positives)
        held = found.groupBy("anchor_id").agg(F.flatten(F.sort_array(F.collect_list(F.array(F.col("rank").cast("long"), "vec_id", "score")))).alias("positives"))
        with_positives = saved(anchors.join(held, "anchor_id"), "positives")

        def windows(extras):
            """Of each anchor's positives, by place: score, least score of a negative, id; where there is none, nothing fits."""
            table = np.full((len(extras), positives, 3), 0, dtype=np.int64)
            table[:, :, 0], table[:, :, 1] = -1, 0
            for i, e in enumerate(extras):
                p = np.array(e, dtype=np.int64).reshape(-1, 3)
                table[i, : len(p), 0], table[i, : len(p), 1], table[i, : len(p), 2] = p[:, 2], -(-least * p[:, 2] // 100), p[:, 1]
            return table

        def meeting(zones, x, labels, extras, in_piece=False):
            low, high = zones.bounds(x)
            table = windows(extras)
            want = np.zeros(low.shape, dtype=bool)
            for place in range(positives):
                want |= (high >= table[:, place, 1, None]) & (low <= table[:, place, 0, None])
            return want & ~((zones.labels[:, 0] == zones.labels[:, 1]) & (zones.labels[:, 0] == labels[:, None]))

        def other_label(scores, ids, labels, extras, row_ids, row_labels):
            table, columns = windows(extras), []
            differ = row_labels != labels[:, None]
            for place in range(positives):
                owner, other = np.nonzero(differ & (scores >= table[:, place, 1, None]) & (scores <= table[:, place, 0, None]))
                kept = best(owner, scores[owner, other], row_ids[other], negatives)
                owner, other = owner[kept], other[kept]
                columns.append((ids[owner], table[owner, place, 2], table[owner, place, 0], scores[owner, other], row_ids[other]))
            return [np.concatenate(c) for c in zip(*columns, strict=True)]

        pairs = meet(with_positives, "positives", blocks, maps, d, parts, meeting, other_label, "anchor_id long, positive_id long, positive_score long, score long, vec_id long")
        mined = _ranked(pairs, ["anchor_id", "positive_id", "positive_score"], negatives)
        result = saved(mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        keep.append(result)
    return result
