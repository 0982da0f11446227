"""Operator 8: best-fit packing into sequences of several permitted lengths.

Documents are counted in tokens and cut into pieces no longer than the longest permitted length.
Pieces are numbered as they are written and dealt by a hash of their numbers into groups of about GROUP_PIECES, and each group is packed by itself, in
decreasing order: a piece goes where it leaves the least room; if it fits nowhere, a bin is opened,
of the permitted length whose cost for each token it can be expected to hold is least; at the end
each bin shrinks to the shortest permitted length that holds its contents. A group has thousands of
pieces, so what is lost at its edges is a bin or two.

Edge cases: documents without tokens (null or empty texts) are returned with a null bin; equal
pieces are taken by doc_id, piece and number; repeated rows, and rows without a doc_id, are each packed, and spread
over groups as others are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import saved

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 48
GROUP_PIECES = 20_000

RESULT = "doc_id long, piece int, start int, n_tokens int, bin_id string, capacity int, offset int"


def count_words(text: Column) -> Column:
    """Words of a text, the default token count; any integer column can take its place."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def pack(sizes: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; sizes: decreasing, at least 1, none above the largest capacity."""
    capacities = sorted(capacities)
    left = np.concatenate((np.cumsum(sizes[::-1])[::-1], [0]))  # tokens from each piece on
    ascending = -sizes  # for searchsorted
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: list[int] = []  # distinct room values of open bins, ascending
    at: dict[int, list[int]] = {}  # bins by room
    filled: list[int] = []

    def put(b: int, space: int) -> None:
        if space:
            if space not in at:
                insort(room, space)
                at[space] = []
            at[space].append(b)

    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(room, s)
        if k < len(room):
            space = room[k]
            b = at[space].pop()
            if not at[space]:
                del at[space], room[k]
        else:
            def cost(c: int) -> float:
                fitting = int(np.searchsorted(ascending, s - c))  # the first piece that fits beside s
                return (c + overhead) / (s + min(c - s, int(left[max(i + 1, fitting)])))

            space = min((c for c in capacities if c >= s), key=cost)
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += s
        put(b, space - s)
    shrunk = np.array(capacities)[np.searchsorted(capacities, filled)] if filled else np.empty(0, dtype=np.int64)
    return bins, offsets, shrunk[bins] if len(bins) else bins


def pack_documents(docs: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD, tokens: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start (its first token in the document), n_tokens, bin_id, capacity, offset."""
    longest = max(capacities)
    counted = docs.select("doc_id", (count_words(F.col("text")) if tokens is None else tokens).cast("int").alias("n"))
    pieces = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.col("n") - F.col("piece") * longest, F.lit(longest)).cast("int").alias("n_tokens"))
    # numbered when written, so that rows of one doc_id, or of none, are told apart
    pieces = saved(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = 1 + pieces.count() // GROUP_PIECES
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, fits = pack(group["n_tokens"].to_numpy(), capacities, overhead)
        return group.assign(bin_id=[f"{g}-{b}" for g, b in zip(group["g"], bins, strict=True)], capacity=fits, offset=offsets)[[f.split()[0] for f in RESULT.split(", ")]]

    packed = dealt.where("n_tokens > 0").groupBy("g").applyInPandas(one, RESULT)
    none = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("offset"))
    return packed.unionByName(none)
