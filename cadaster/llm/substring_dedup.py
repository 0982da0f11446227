"""Operator 10: substring dedup with a count-min prefilter.

A word goes if a window of 50 words that covers it also starts in a document with a smaller doc_id.

1. Sketch. A window's count is estimated by the count of its anchor, the 12-word run of least hash in
   it: equal windows have equal anchors at equal places, so an anchor is in as many documents at least
   as any window it stands for, and anchors are twenty times fewer than windows. The sketch is cut
   into blocks, each a small count-min table of its own: a hash deals an anchor to a block, others to a
   counter in each of the block's ROWS rows. Each partition counts its anchors by block; partition
   sketches are added block by block, and a block's anchors are looked up in it by a join. Hashing can
   only add to a count: a window in two documents is estimated at two or more, and none is lost.
2. Exact pass. Only windows estimated repeated are grouped, by a digest of their words, for the smallest
   document that each starts in; windows of larger documents are hits. Grouping pre-aggregates and
   the join is of two written tables, so that a window in a third of all documents is split up.
3. Texts are joined with their hits and cut.

The number of blocks grows with the corpus, and no block, bitmap or list of documents leaves the
executors: memory is the same at every size. A window's digest is 96 bits of BLAKE2b of its words; of
10^13 different windows, the chance that any two have the same is below one in a thousand.

Edge cases: null and empty texts have no words; texts under 50 words are never cut; a null doc_id is
never cut and cuts nothing; repeated rows are cut alike and never by each other (doc_id is a key:
where rows of one doc_id differ in text, each loses what was found at those places in any); columns
other than doc_id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import by_merge, forget, saved
from cadaster.llm.text import Joined, digest as digest_of, distinct, mix, together

WINDOW, ANCHOR = 50, 12
ROWS = 2
#: Counters in a row of a block, and anchors expected in a block: eight counters for each.
COUNTER_BITS = 16
BLOCK_ANCHORS = 1 << 13
#: Anchors gathered before a partial sketch is written, and the most that stand in one of its rows.
GATHERED, TOGETHER = 1_000_000, 1 << 16


def anchors(joined: Joined, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where windows start, for each the place of its anchor, hashes of the runs of `anchor` words)."""
    at = joined.windows(window)
    if not len(at):
        return at, at, np.empty(0, dtype=np.uint64)
    starts = np.arange(len(joined.starts) - anchor + 1)
    runs = joined.runs.between(starts, starts + anchor)
    wide = np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1)
    return at, wide.argmin(axis=1)[at] + at, runs


def counters(hashes: np.ndarray, row: int) -> np.ndarray:
    """The anchors' counters in a row of their block."""
    return (hashes >> np.uint64(COUNTER_BITS * row) & np.uint64((1 << COUNTER_BITS) - 1)).astype(np.int64)


def anchors_by_block(docs: DataFrame, blocks: int, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """block, docs, hashes: each document's distinct anchors, those of a block together as far as a partition holds them."""
    import pyarrow as pa

    def rows(docs_, hashes):
        block = (mix(hashes) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        hashes, block, docs_ = hashes[order], block[order], docs_[order]
        # a block's run is cut where it is long, so that no row is large
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        start = np.concatenate([np.arange(a, b, TOGETHER) for a, b in zip(edge, np.append(edge[1:], len(block)), strict=True)])
        at = pa.array(np.append(start, len(block)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (docs_, hashes.view(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(block[start]), *lists], names=["block", "docs", "hashes"])

    def run(batches):
        docs_, found, held = [], [], 0
        for b in batches:
            ids, raws = b.column(0).to_numpy(), b.column(1).to_pylist()
            for start, end in together(raws):
                joined = Joined(raws[start:end])
                _, places, runs = anchors(joined, window, anchor)
                used = np.unique(places)
                begin, hashes = distinct(joined.of[used], runs[used], end - start)
                docs_.append(np.repeat(ids[start:end], np.diff(begin)))
                found.append(hashes)
                held += len(hashes)
            if held > GATHERED:
                yield rows(np.concatenate(docs_), np.concatenate(found))
                docs_, found, held = [], [], 0
        if held:
            yield rows(np.concatenate(docs_), np.concatenate(found))

    return docs.select("doc_id", "text").mapInArrow(run, "block long, docs array<bigint>, hashes array<bigint>")


def sketch(dealt: DataFrame) -> DataFrame:
    """block, bits: of each block's counters, by row, those that count two or more."""
    import pandas as pd
    import pyarrow as pa

    def partial(batches):
        for b in batches:
            out = []
            for block, hashes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                hashes = hashes.values.to_numpy().view(np.uint64)
                for row in range(ROWS):
                    at, times = np.unique(counters(hashes, row), return_counts=True)
                    out.append((block, row, at.astype(np.int32).tobytes(), np.minimum(times, 2).astype(np.uint8).tobytes()))
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in columns], names=["block", "row", "at", "times"])

    def add(key, parts):
        total = np.zeros((ROWS, 1 << COUNTER_BITS), dtype=np.uint8)
        for row, at, times in zip(parts["row"], parts["at"], parts["times"], strict=True):
            at = np.frombuffer(at, dtype=np.int32)
            total[row, at] = np.minimum(total[row, at] + np.frombuffer(times, dtype=np.uint8), 2)
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(total > 1, bitorder="little").tobytes()]})

    parts = dealt.select("block", "hashes").mapInArrow(partial, "block long, row int, at binary, times binary")
    return parts.groupBy("block").applyInPandas(add, "block long, bits binary")


def estimated_repeated(dealt: DataFrame, sketched: DataFrame) -> DataFrame:
    """doc_id, anchors: of each document, those whose count is estimated at two or more."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for docs_, hashes, bits in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                docs_, hashes = docs_.values.to_numpy(), hashes.values.to_numpy()
                table = np.frombuffer(bits, dtype=np.uint8)
                known = np.ones(len(hashes), dtype=bool)
                for row in range(ROWS):
                    at = counters(hashes.view(np.uint64), row) + (row << COUNTER_BITS)
                    known &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if known.any():
                    yield pa.RecordBatch.from_arrays([pa.array(docs_[known]), pa.array(hashes[known])], names=["doc_id", "anchor"])

    found = by_merge(dealt, sketched, "block").select("docs", "hashes", "bits").mapInArrow(run, "doc_id long, anchor long")
    return found.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def repeated_windows(docs: DataFrame, estimated: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, at, key, check of each window whose anchor is estimated repeated; key and check are its digest."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, raws, lists = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2)
            for start, end in together(raws):
                joined = Joined(raws[start:end])
                at, places, runs = anchors(joined, window, anchor)
                used, back = np.unique(places, return_inverse=True)
                # an anchor is estimated repeated wherever it is
                known = np.isin(runs[used], lists.slice(start, end - start).flatten().to_numpy().view(np.uint64))
                found = at[known[back]]
                if not len(found):
                    continue
                # each word and a space: the words from one to another are a slice of these bytes
                words = b" ".join(joined.raw.split())
                ends = np.cumsum(joined.ends - joined.starts + 1)
                begins = ends - (joined.ends - joined.starts + 1)
                keys = b"".join([digest_of(words[i:j], 12) for i, j in zip(begins[found].tolist(), (ends[found + window - 1] - 1).tolist(), strict=True)])
                keys = np.frombuffer(keys, dtype=np.dtype([("key", "<i8"), ("check", "<i4")]))
                own = joined.of[found]
                columns = ids[start:end][own], (found - joined.first[own]).astype(np.int32), np.ascontiguousarray(keys["key"]), np.ascontiguousarray(keys["check"])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "at", "key", "check"])

    return by_merge(docs.select("doc_id", "text"), estimated, "doc_id").mapInArrow(run, "doc_id long, at int, key long, check int")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words left, joined by one space) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    known = docs.where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # windows of six-byte words, two anchors for each stretch of window - anchor words
    blocks = 1 + 2 * size // (6 * (window - anchor + 1) * BLOCK_ANCHORS)
    dealt = saved(anchors_by_block(known, blocks, window, anchor), "anchors")
    sketched = saved(sketch(dealt), "sketch")
    estimated = saved(estimated_repeated(dealt, sketched), "estimated")
    forget(dealt, sketched)
    windows = saved(repeated_windows(known, estimated, window, anchor), "windows")
    first = saved(windows.groupBy("key", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "first")
    found = by_merge(windows, first, ["key", "check"]).where(F.col("doc_id") > F.col("first"))
    hits = saved(found.groupBy("doc_id").agg(F.collect_list("at").alias("hits")), "hits")
    forget(estimated, windows, first)
    return by_merge(docs, hits, "doc_id", "left").select("doc_id", "text", "hits").mapInArrow(_cut(window), "doc_id long, n_words bigint, n_removed bigint, kept_text string")


def _cut(window: int):
    """doc_id, text, hits (starts of windows to remove) to the words left."""
    import pyarrow as pa

    def one(raw: bytes, hits: list[int] | None):
        words = raw.split()
        starts = np.unique(np.array(hits or [], dtype=np.int64))
        starts = starts[starts <= len(words) - window]
        if not len(starts):
            return len(words), 0, b" ".join(words).decode("utf-8", "replace")
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        cover[starts] += 1
        cover[starts + window] -= 1
        kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
        return len(words), len(words) - len(kept), b" ".join([words[i] for i in kept.tolist()]).decode("utf-8", "replace")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, removed, kept = zip(*(one(raw or b"", hits) for raw, hits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)), strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
