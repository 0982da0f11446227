"""Operator 12: suffix-array dedup by a distributed merge sort that knows common prefixes.

A byte goes if a string of 200 bytes that covers it starts anywhere else, in the same document or
another. Strings that start at neighbouring bytes are decided together:

1. Sampling. Every string of 200 bytes has an anchor, the 64-byte gram of least hash in it (the first of
   equals). Equal strings have anchors at equal places, so a string can only be repeated if its anchor's
   gram is. Grams are counted, and only suffixes at anchors with a repeated gram are sorted: of the
   bytes of a text, one in seventy at most.
2. Runs. Each task sorts its suffixes, cut where the strings of their anchor end, with the bytes left of
   the anchor as second key, and front-codes them: of each only what the one before does not share. Suffixes
   that are equal inside a run with all that is left of them are repeated at once; one of them goes on.
3. Exchange. A run is dealt out by its anchors' grams; a share gets one sorted piece of each run.
4. Merge. A loser tree merges the pieces of a share. It keeps the common prefix of each head with the last
   suffix that came out: the head that shares more is the lesser, and bytes are compared only from where
   two heads share the same number. What comes out is the order of suffixes and their common prefixes.
5. Decision. A string that starts o bytes left of its anchor is repeated if another suffix shares 200 - o bytes
   to the right and o to the left: both are ranges of the two sorted orders, cut where the common prefix is
   shorter, and for each o suffixes in the same pair of ranges are repeated.
6. Texts are joined with the spans found and cut.

A gram that occurs more than `hot` times has its strings sorted one by one, dealt out by all their 200 bytes, so that
no share grows with a passage that many documents share between differing neighbours. Shares have bounded size; memory does
not grow with the corpus. Hashes choose and deal; what is taken out as equal was compared byte by byte.

Edge cases: null texts are empty; texts under 200 bytes are never cut and cut nothing; every row is a document of
its own, also where doc_id is null or repeated, so that equal rows of 200 bytes or more lose all; columns other than
doc_id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import by_merge, forget, saved
from cadaster.llm.text import TOGETHER, mix, together

LENGTH, GRAM = 200, 64
#: The furthest that a string of an anchor starts left of it.
LEFT = LENGTH - GRAM
#: Longer texts are looked through in pieces that share LENGTH - 1 bytes.
PIECE = 1 << 22
#: Suffixes in a run, and about as many in a share; the occurrences from which a gram's strings are sorted one by one.
RUN, HOT = 1 << 16, 1 << 15
U = np.uint64
_KEYS = [U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Low bits of a gram's rank hold its place, so that of equal hashes the first is least.
_PLACE = U((1 << 28) - 1)
#: A suffix to be sorted: its row, the place of its anchor, its bytes from there, those it shares with the one before, those to the left, whether it is repeated already.
ITEM = np.dtype([("id", "<i8"), ("check", "<i8"), ("place", "<i8"), ("size", "u1"), ("shared", "u1"), ("left", "u1"), ("known", "u1")])
SPAN = np.dtype([("id", "<i8"), ("check", "<i8"), ("begin", "<i8"), ("end", "<i8")])
#: Columns of a suffix as it is sorted inside a run: bytes to the right, their number, bytes to the left, nearest first, their number.
_SIZE_AT, _WIDTH = LENGTH, LENGTH + 1 + LEFT + 1


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes."""
    lanes = np.ndarray(max(0, len(a) - 7), dtype="<u8", buffer=a.data, strides=(1,))
    h = lanes * _KEYS[0]
    for width, key in zip((8, 16, 32), _KEYS[1:], strict=True):
        h ^= h >> U(29)
        h = h[:-width] * key + h[width:]
    h ^= h >> U(32)
    h *= _KEYS[0]
    return h


class Anchored:
    """The anchors of a few texts: text, first and last start of its strings, place of the gram (all in `a`), and its hash."""

    def __init__(self, a: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        self.a = a
        grams = gram_hashes(a)
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
        width = 1
        while 2 * width <= LEFT + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width <= LEFT:
            more = LEFT + 1 - width
            least = np.minimum(least[:-more], least[more:])
        at = (least & _PLACE).astype(np.int64)
        edges = np.concatenate((np.flatnonzero(at[1:] != at[:-1]) + 1, begins, ends - LENGTH + 1))
        edges = np.unique(edges[(edges >= 0) & (edges < len(at))])
        of = np.searchsorted(begins, edges, side="right") - 1
        good = edges + LENGTH <= ends[of]
        self.last = np.append(edges[1:], len(at))[good] - 1
        self.first, self.of = edges[good], of[good]
        self.at = at[self.first]
        self.gram = grams[self.at]

    def suffixes(self, known: np.ndarray) -> np.ndarray:
        """Chosen anchors as rows to be sorted."""
        out = np.zeros((len(known), _WIDTH), dtype=np.uint8)
        place, size, left = self.at[known], self.last[known] + LENGTH - self.at[known], self.at[known] - self.first[known]
        for columns, n, start, step in ((out[:, :LENGTH], size, place, 1), (out[:, _SIZE_AT + 1 : -1], left, place - 1, -1)):
            offset = np.arange(columns.shape[1])
            columns[:] = self.a[np.clip(start[:, None] + step * offset, 0, len(self.a) - 1)]
            columns[offset >= n[:, None]] = 0
        out[:, _SIZE_AT], out[:, -1] = size, left
        return out

    def strings(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, start) of each string of chosen anchors."""
        n = self.last[known] - self.first[known] + 1
        anchor = np.repeat(known, n)
        return anchor, self.first[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n)


def anchored(raws: list[bytes | None]) -> Iterator[tuple[Anchored, np.ndarray, np.ndarray]]:
    """Anchors of texts hashed together, with the number of each of its texts in raws, and where in it the text begins less where in `a`."""
    for start, end in together(raws):
        if end - start == 1 and len(raws[start] or b"") > TOGETHER:
            raw = raws[start]
            for shift in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                a = np.frombuffer(raw[shift : shift + PIECE + LENGTH - 1], dtype=np.uint8)
                yield Anchored(a, np.array([0]), np.array([len(a)])), np.array([start]), np.array([shift])
        else:
            some = [i for i in range(start, end) if len(raws[i] or b"") >= LENGTH]
            if some:
                ends = np.cumsum([len(raws[i]) for i in some])
                begins = np.append(0, ends[:-1])
                yield Anchored(np.frombuffer(b"".join([raws[i] for i in some]), dtype=np.uint8), begins, ends), np.array(some), -begins


def with_keys(docs: DataFrame, text: str) -> DataFrame:
    """id and check tell a row of docs; equal rows are told by the same."""
    raw = F.col(text).cast("binary")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.xxhash64(raw, F.col("doc_id").isNull()).alias("check"), raw.alias("text"))


def grams(docs: DataFrame) -> DataFrame:
    """id, check, gram of each anchor."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, checks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for found, texts, _ in anchored(b.column(2).to_pylist()):
                own = texts[found.of]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(checks[own]), pa.array(found.gram.view(np.int64))], names=["id", "check", "gram"])

    return docs.where(F.octet_length("text") >= LENGTH).select("id", "check", "text").mapInArrow(run, "id long, check long, gram long")


def repeated_grams(found: DataFrame, hot: int) -> DataFrame:
    """id, check, grams, hot_grams: of each row's grams, those that occur twice or more."""
    known = saved(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > hot).alias("hot")), "repeated-grams")
    rows = by_merge(found, known, "gram").groupBy("id", "check")
    out = saved(rows.agg(F.collect_set(F.when(~F.col("hot"), F.col("gram"))).alias("grams"), F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("hot_grams")), "grams-of-rows")
    forget(known)
    return out


def share_of(strings: np.ndarray) -> np.ndarray:
    """A hash of each row of LENGTH bytes."""
    lanes = np.ascontiguousarray(strings).view("<u8")
    return mix((lanes * (mix(np.arange(1, lanes.shape[1] + 1, dtype=U)) | U(1))).sum(axis=1, dtype=U))


class Runs:
    """Gathers suffixes and gives them out as sorted, front-coded runs, cut by share."""

    def __init__(self, shares: int) -> None:
        self.shares, self.held = U(shares), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, checks: np.ndarray, places: np.ndarray, dealt_by: np.ndarray) -> None:
        if len(rows):
            items = np.zeros(len(rows), dtype=ITEM)
            items["id"], items["check"], items["place"] = ids, checks, places
            self.parts.append((rows, items, mix(dealt_by) % self.shares))
            self.held += len(rows)

    def sorted(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """share, items, bytes right of the anchors that the suffix before has not, bytes left of them, spans repeated inside the run."""
        if not self.held:
            return
        rows, items, share = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((rows.view(f"S{_WIDTH}").ravel(), share))
        rows, items, share = rows[order], items[order], share[order]
        items["size"], items["left"] = rows[:, _SIZE_AT], rows[:, -1]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (share[1:] != share[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        twice = np.bincount(group) > 1
        again = items[twice[group]]
        spans = np.zeros(len(again), dtype=SPAN)
        for k in ("id", "check"):
            spans[k] = again[k]
        spans["begin"], spans["end"] = again["place"] - again["left"], again["place"] + again["size"]
        rows, items, share = rows[new], items[new], share[new]
        items["known"] = twice
        right, left = rows[:, :LENGTH], rows[:, _SIZE_AT + 1 : -1]
        items["shared"] = shared_bytes(right, items["size"])
        edge = np.flatnonzero(np.diff(share, prepend=share[0] + U(1)))
        items["shared"][edge] = 0
        offset = np.arange(LENGTH)
        for n, (a, b) in enumerate(zip(edge, np.append(edge[1:], len(rows)), strict=True)):
            part = items[a:b]
            tails = right[a:b][(offset >= part["shared"][:, None]) & (offset < part["size"][:, None])]
            lefts = left[a:b][offset[:LEFT] < part["left"][:, None]]
            # spans are no part of the order: any share takes them along
            own = spans[len(spans) * n // len(edge) : len(spans) * (n + 1) // len(edge)]
            yield int(share[a]), part.tobytes(), tails.tobytes(), lefts.tobytes(), own.tobytes()


def shared_bytes(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before; the first none."""
    out = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def runs(docs: DataFrame, known: DataFrame, shares: int, run: int = RUN) -> DataFrame:
    import pyarrow as pa

    fields = {"share": pa.int64(), "items": pa.binary(), "tails": pa.binary(), "lefts": pa.binary(), "spans": pa.binary()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))

    def work(batches):
        gathered = Runs(shares)
        for b in batches:
            ids, checks, cold, hot = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), b.column(4)
            raws = b.column(2).to_pylist()
            sets = [np.unique(x.flatten().to_numpy(zero_copy_only=False)).view(U) for x in (cold, hot)]
            for found, texts, shift in anchored(raws):
                once = np.flatnonzero(np.isin(found.gram, sets[0]))
                own = found.of[once]
                gathered.add(found.suffixes(once), ids[texts[own]], checks[texts[own]], found.at[once] + shift[own], found.gram[once])
                anchor, start = found.strings(np.flatnonzero(np.isin(found.gram, sets[1])))
                for at in range(0, len(anchor), run):
                    one, places = found.of[anchor[at : at + run]], start[at : at + run]
                    rows = np.zeros((len(one), _WIDTH), dtype=np.uint8)
                    rows[:, :LENGTH] = found.a[places[:, None] + np.arange(LENGTH)]
                    rows[:, _SIZE_AT] = LENGTH
                    gathered.add(rows, ids[texts[one]], checks[texts[one]], places + shift[one], share_of(rows[:, :LENGTH]))
                    if gathered.held >= run:
                        yield batch(gathered.sorted())
                if gathered.held >= run:
                    yield batch(gathered.sorted())
        if gathered.held:
            yield batch(gathered.sorted())

    rows = by_merge(docs.select("id", "check", "text"), known, ["id", "check"]).select("id", "check", "text", "grams", "hot_grams")
    return rows.mapInArrow(work, "share long, items binary, tails binary, lefts binary, spans binary")


def merge(pieces: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """All strings of sorted pieces in order, by their number over all pieces, and the bytes that each shares with the one before.

    shared: of each string of a piece, what it shares with the one before it there. A loser keeps what it shares with
    the winner it met, which is the last to come out when they meet again.
    """
    width = 1 << max(0, len(pieces) - 1).bit_length()
    heads: list[bytes | None] = [p[0] if p else None for p in pieces] + [None] * (width - len(pieces))
    base = np.cumsum([0, *map(len, pieces)]).tolist()
    at, common = [0] * width, [0] * width
    losers = [-1] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        n = common[a]
        if n != common[b]:
            return (a, b) if n > common[b] else (b, a)
        end = min(len(x), len(y))
        u, v = x[n:end], y[n:end]
        if u == v:
            n = end
            less = len(x) <= len(y)
        else:
            n = end - ((int.from_bytes(u) ^ int.from_bytes(v)).bit_length() + 7) // 8
            less = u < v
        if less:
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    winners = [*[-1] * width, *range(width)]
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best, order, prefixes = winners[1], [], []
    while heads[best] is not None:
        order.append(base[best] + at[best])
        prefixes.append(common[best])
        at[best] = n = at[best] + 1
        if n < len(pieces[best]):
            heads[best], common[best] = pieces[best][n], shared[best][n]
        else:
            heads[best] = None
        node = (best + width) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
    return order, prefixes


def decoded(items: np.ndarray, tails: bytes) -> list[bytes]:
    """The strings of a front-coded piece."""
    out, before, at = [], b"", 0
    for size, shared in zip(items["size"].tolist(), items["shared"].tolist(), strict=True):
        before = before[:shared] + tails[at : at + size - shared]
        at += size - shared
        out.append(before)
    return out


def repeated(items: np.ndarray, prefixes: np.ndarray, lefts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, o, last) by entry: the strings from o to `last` bytes left of the suffix's anchor are repeated.

    items: in order of the bytes right of the anchors; prefixes: what each shares with the one before; lefts: the bytes to the left, by row.
    """
    n = len(items)
    size, left = items["size"].astype(np.int64), items["left"].astype(np.int64)
    order = np.argsort(np.concatenate((lefts, items["left"][:, None]), axis=1).view(f"S{LEFT + 1}").ravel(), kind="stable")
    common = shared_bytes(lefts[order], left[order])

    def right_ranges(starts: np.ndarray) -> np.ndarray:
        starts[0] = True
        return np.cumsum(starts)

    def left_ranges(starts: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[order] = right_ranges(starts)
        return out

    new_right, new_left = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    new_right[1:] = (prefixes[1:] < size[1:]) | (size[1:] != size[:-1])
    new_left[1:] = (common[1:] < left[order][1:]) | (left[order][1:] != left[order][:-1])
    _, leads, back, times = np.unique(right_ranges(new_right) * (n + 1) + left_ranges(new_left), return_index=True, return_inverse=True, return_counts=True)
    # what is equal with all that is left of it is repeated in full; the first of equals stands for them below
    same = times[back] > 1
    full = np.flatnonzero(same)
    unsure = ~same & (items["known"] == 0)
    first = np.zeros(n, dtype=bool)
    first[leads] = True
    gram = right_ranges(prefixes < GRAM)
    some = np.flatnonzero(first & (np.bincount(gram[first], minlength=n + 2)[gram] > 1) & (np.bincount(gram[unsure], minlength=n + 2)[gram] > 0))
    hit = np.zeros((len(some), LEFT + 1), dtype=bool)
    for o in range(LEFT + 1):
        now = np.flatnonzero((LENGTH - size[some] <= o) & (o <= left[some]))
        if len(now) > 1:
            at = some[now]
            _, back, times = np.unique(right_ranges(prefixes < LENGTH - o)[at] * (n + 1) + left_ranges(common < o)[at], return_inverse=True, return_counts=True)
            hit[now, o] = times[back] > 1
    hit[~unsure[some]] = False
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    (which, o), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return np.concatenate((full, some[which])), np.concatenate((LENGTH - size[full], o)), np.concatenate((left[full], stop - 1))


def merged(share) -> np.ndarray:
    """The repeated spans of a share's pieces."""
    spans = [np.frombuffer(x, dtype=SPAN) for x in share["spans"]]
    rows = [(np.frombuffer(i, dtype=ITEM), t, np.frombuffer(f, dtype=np.uint8)) for i, t, f in zip(share["items"], share["tails"], share["lefts"], strict=True) if len(i)]
    if rows:
        items = np.concatenate([i for i, _, _ in rows])
        lefts = np.zeros((len(items), LEFT), dtype=np.uint8)
        lefts[np.arange(LEFT) < items["left"][:, None]] = np.concatenate([f for _, _, f in rows])
        order, prefixes = merge([decoded(i, t) for i, t, _ in rows], [i["shared"].tolist() for i, _, _ in rows])
        items, lefts = items[order], lefts[order]
        which, o, last = repeated(items, np.array(prefixes, dtype=np.int64), lefts)
        hit = items[which]
        out = np.zeros(len(hit), dtype=SPAN)
        out["id"], out["check"], out["begin"], out["end"] = hit["id"], hit["check"], hit["place"] - last, hit["place"] + LENGTH - o
        spans.append(out[hit["known"] == 0])
    return np.concatenate(spans)


def dedup(docs: DataFrame, text: str = "text", run: int = RUN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (begin and end of each run of bytes that goes), kept (the bytes left) of every document."""
    import pandas as pd

    docs = with_keys(docs, text)
    found = saved(grams(docs), "grams")
    known = repeated_grams(found, hot)
    count = known.agg(F.sum(F.size("grams")), F.sum(F.size("hot_grams"))).first()
    forget(found)
    shares = 1 + ((count[0] or 0) + (LEFT + 1) // 2 * (count[1] or 0)) // run

    def spans_of(share: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(merged(share))

    hits = runs(docs, known, shares, run).groupBy("share").applyInPandas(spans_of, "id long, check long, begin long, end long")
    spans = saved(hits.groupBy("id", "check").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    forget(known)
    return by_merge(docs, spans, ["id", "check"], "left").select("doc_id", "text", "spans.begin", "spans.end").mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<begin: int, end: int>>, kept binary")


def _cut(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def one(raw: bytes, begins: list[int] | None, ends: list[int] | None):
        spans: list[list[int]] = []
        for a, b in sorted(zip(begins or [], ends or [], strict=True)):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        edges = [0, *(x for s in spans for x in s), len(raw)]
        kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
        return len(raw), len(raw) - len(kept), [{"begin": a, "end": b} for a, b in spans], kept

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            n, removed, spans, kept = zip(*(one(raw or b"", x, y) for raw, x, y in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)), strict=True)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
