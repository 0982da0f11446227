"""Operator 9: line dedup by a deletion-neighbourhood join.

A line is its words, A-Z lower-cased; the edit unit is the word. A line goes if an earlier line, by
(doc_id, line number), is equal, or is one word edit away (a word inserted, deleted or replaced) and
both have MIN_WORDS words at least: one edit in five words is the similarity of 0.8 that near copies
take. The earliest stays.

1. Equal lines become one distinct line, the earliest, by a digest of 128 bits of their words.
2. Of the thirds of a line an edit leaves two as they are, so only lines that share two thirds with
   another distinct line can have a neighbour. Pairs of thirds are counted by a grouping and joined back.
3. Those lines emit themselves and all their one-word deletions as hashed keys. Replaced words meet in
   a key with equal place, inserted and deleted ones in a key of the shorter line itself. A group needs
   its earliest line only: in it all lines are one edit apart, so no pairs are listed.
4. Each line and its earliest neighbour are compared word by word, and texts are cut.

What grows with the corpus is grouped and joined, never broadcast or gathered. Where many lines have
the same neighbour, copies of it are dealt to parts of them.

Edge cases: null and empty texts have no lines; lines without a word are left as they are; a null
doc_id is never cut and cuts nothing; repeated rows are cut alike and never by each other (doc_id is
a key: where rows of one doc_id differ in text, each loses the lines found at those places in any);
other columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import by_merge, forget, saved, split_join
from cadaster.llm.text import LOWER, SPACED, Runs, digest as digest_of, mix, spans, word_hashes

MIN_WORDS = 5

#: Lengths that lines are taken for when their thirds are compared: the largest of these up to their own.
LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 56, 64, 80, 96, 128, 160, 192, 256, 384, 512])
#: Texts are hashed together up to so many bytes; a longer one by itself.
TOGETHER = 1 << 18
#: Keys of pairs of thirds: three of the line's own length and three of that of a line shorter by a word.
THIRDS = [f"third_{i}" for i in range(6)]


def together(docs: list, raws: list) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(doc_ids, their texts a line apart, the first line of each) of texts in groups of TOGETHER bytes."""
    held, size = [], 0
    for doc, raw in zip(docs, raws, strict=True):
        raw = raw or b""
        if held and size + len(raw) > TOGETHER:
            yield _joined(held)
            held, size = [], 0
        held.append((doc, raw))
        size += len(raw) + 1
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, bytes, np.ndarray]:
    lines = np.array([raw.count(b"\n") + 1 for _, raw in held])
    return np.array([doc for doc, _ in held]), b"\n".join([raw for _, raw in held]).translate(LOWER), np.cumsum(lines) - lines


def lines_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the lines that have a word, their first words, words after their last, word hashes) of a text in lower case."""
    a, starts, ends = spans(raw, SPACED)
    of = np.searchsorted(np.flatnonzero(a == 10), starts)  # the line of each word
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], first, np.append(first[1:], len(starts)).astype(np.int64), word_hashes(a, starts, ends)


def thirds_of(runs: Runs, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, whether there is one) of each of the pairs of thirds of lines of two words at least.

    Two lines one edit apart share a key. Let the shorter have n words, n be taken for l <= n, and b
    be a third of l, rounded up. An edit at word l - b or later leaves the first l - b words alike, one
    before word b the last l - b, and one between them the first b and the last b.
    """
    n, out = end - start, []
    own, shorter = (LENGTHS[np.searchsorted(LENGTHS, x, side="right") - 1] for x in (n, n - 1))
    for l, there in ((own, np.ones(len(n), dtype=bool)), (shorter, shorter != own)):
        b, size = (l + 2) // 3, mix(l.astype(np.uint64))
        ends = runs.between(start, start + l - b), runs.between(end - l + b, end), mix(runs.between(start, start + b)) + runs.between(end - b, end)
        out += [(mix(key + size + np.uint64(kind)), there) for kind, key in enumerate(ends)]
    return out


def _plain(line: bytes) -> bytes:
    return b" ".join(line.split())


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, line, d1, d2 of every line that has a word, whether an equal one is above it in the text, and else the keys of its thirds."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for docs_, raw, first in together(b.column(0).to_pylist(), b.column(1).to_pylist()):
                numbers, start, end, words = lines_of(raw)
                if not len(numbers):
                    continue
                of = np.searchsorted(first, numbers, side="right") - 1
                lines = raw.split(b"\n")
                digests = [digest_of(_plain(lines[i])) for i in numbers.tolist()]
                seen, again = set(), np.zeros(len(numbers), dtype=bool)
                for i, at in enumerate(zip(of.tolist(), digests, strict=True)):
                    again[i] = at in seen
                    seen.add(at)
                d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                able = np.flatnonzero((end - start >= least) & ~again)
                thirds = []
                for key, there in thirds_of(Runs(words), start[able], end[able]):
                    value, none = np.zeros(len(numbers), dtype=np.int64), np.ones(len(numbers), dtype=bool)
                    value[able], none[able] = key.view(np.int64), ~there
                    thirds.append(pa.array(value, mask=none))
                columns = [pa.array(docs_[of]), pa.array((numbers - first[of]).astype(np.int32)), *(pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1)), pa.array(again), *thirds]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "d1", "d2", "again", *THIRDS])

    fields = ", ".join(f"{t} long" for t in THIRDS)
    return docs.mapInArrow(run, f"doc_id long, line int, d1 long, d2 long, again boolean, {fields}")


def _neighbourhoods(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """v, v2, at, doc_id, line, words: of each candidate line (doc_id, lines), itself (at = -1, with its words) and its one-word deletions."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            given = b.column(2).to_pylist()
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                wanted = dict(zip(part.column(0).to_pylist(), given[at : at + 512], strict=True))
                for docs_, raw, first in together(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    numbers, start, end, words = lines_of(raw)
                    # the wanted lines' numbers in the texts together; another text of the same doc_id may lack one
                    asked = np.array([above + i for doc, above in zip(docs_.tolist(), first.tolist(), strict=True) for i in wanted[doc]], dtype=np.int64)
                    at_ = np.flatnonzero(np.isin(numbers, asked))
                    if not len(at_):
                        continue
                    numbers, start, end, lines = numbers[at_], start[at_], end[at_], raw.split(b"\n")
                    own = np.searchsorted(first, numbers, side="right") - 1
                    n = end - start
                    of = np.repeat(np.arange(len(n)), n)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    v, v2 = (np.concatenate((r.without(start[of] + place, start[of], end[of]), r.between(start, end))) for r in (Runs(words), Runs(words, "check")))
                    of, place = np.append(of, np.arange(len(n))), np.append(place, np.full(len(n), -1)).astype(np.int32)
                    plain = pa.array([_plain(lines[i]).decode("utf-8", "replace") for i in numbers.tolist()], pa.string())
                    columns = [v.view(np.int64), (v2 >> np.uint64(32)).astype(np.uint32).view(np.int32), place, docs_[own[of]], (numbers - first[own])[of].astype(np.int32)]
                    spelt = pa.concat_arrays([pa.nulls(len(of) - len(n), pa.string()), plain])
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), spelt], names=["v", "v2", "at", "doc_id", "line", "words"])

    rows = by_merge(docs.select("doc_id", "text"), candidates, "doc_id").select("doc_id", "text", "lines")
    return rows.mapInArrow(run, "v long, v2 int, at int, doc_id long, line int, words string")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are one edit apart at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, line of distinct lines that an earlier one is one edit away from."""
    thirds = distinct.where(f"{THIRDS[0]} is not null").select("doc_id", "line", "d1", F.explode(F.array(*THIRDS)).alias("third")).where("third is not null")
    shared = saved(thirds.groupBy("third").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least < most").select("third"), "thirds")
    candidates = saved(by_merge(thirds.select("doc_id", "line", "third"), shared, "third", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("lines")), "candidates")
    keys = saved(_neighbourhoods(docs, candidates), "deletions")
    forget(shared, candidates)
    # most keys are met by no other line
    me = F.struct("doc_id", "line")
    met = keys.groupBy("v", "v2").agg(F.count("*").alias("n")).where("n > 1").select("v", "v2")
    rows = saved(by_merge(keys.select("v", "v2", "at", me.alias("me")), met, ["v", "v2"], "left_semi"), "met")
    places = saved(rows.groupBy("v", "v2", "at").agg(F.min("me").alias("low"), F.count("*").alias("n")), "places")
    replaced = places.where("at >= 0 and n > 1").select("v", "v2", "at", "low")
    shorter = places.groupBy("v", "v2").agg(F.min(F.when(F.col("at") < 0, F.col("low"))).alias("own"), F.min(F.when(F.col("at") >= 0, F.col("low"))).alias("longer"))
    shorter = shorter.where("own is not null and longer is not null")
    by_place = by_merge(rows, replaced, ["v", "v2", "at"]).select("me", F.col("low").alias("other"))
    by_length = by_merge(rows, shorter, ["v", "v2"]).select("me", F.when(F.col("at") < 0, F.col("longer")).otherwise(F.col("own")).alias("other"))
    pairs = saved(by_place.unionByName(by_length).where("other < me").groupBy("me").agg(F.min("other").alias("other")), "pairs")
    words = keys.where("at < 0").select(me.alias("me"), "words").dropDuplicates(["me"])
    earlier = words.select(F.col("me").alias("other"), F.col("words").alias("earlier"))
    both = by_merge(split_join(pairs, earlier, "other", "me"), words, "me")

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            a, c = b.column(2).to_pylist(), b.column(3).to_pylist()
            yield b.filter(pa.array([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, c, strict=True)], pa.bool_())).select([0, 1])

    columns = both.select(F.col("me.doc_id").alias("doc_id"), F.col("me.line").alias("line"), "words", "earlier")
    near = saved(columns.mapInArrow(verify, "doc_id long, line int"), "near")
    forget(keys, rows, places, pairs)
    return near


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs with `text` cut, and n_lines and n_removed: its lines that had a word, and those taken out.

    least: words that a line must have to be compared for edits, two at the lowest. Older columns
    named n_lines and n_removed are replaced.
    """
    import pyarrow as pa

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    lines = saved(_lines(known, max(least, 2)), "lines")
    fresh = lines.where("not again")
    firsts = F.min("doc_id").alias("doc_id"), F.min_by("line", "doc_id").alias("line"), F.count("*").alias("n")
    distinct = saved(fresh.groupBy("d1", "d2").agg(*firsts, *(F.max(t).alias(t) for t in THIRDS)), "distinct")
    copied = distinct.where("n > 1").select("d1", "d2", F.col("doc_id").alias("first"))
    copies = by_merge(fresh.select("doc_id", "line", "d1", "d2"), copied, ["d1", "d2"]).where("doc_id > first").select("doc_id", "line")
    copies = saved(copies.unionByName(lines.where("again").select("doc_id", "line")), "copies")
    forget(lines)
    near = _near(known, distinct)
    gone = saved(copies.unionByName(near).groupBy("doc_id").agg(F.collect_set("line").alias("__gone")), "gone")
    forget(distinct, copies, near)

    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "__doc", "__gone")]
    out = docs.select(*keep).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    at = keep.index("text")

    def rewritten(text: str | None, gone: list[int] | None):
        lines, drop = (text or "").split("\n"), set(gone or ())
        words = sum(1 for x in lines if x.strip(" \t\n\x0b\x0c\r"))
        return "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text, words, len(drop)

    def rewrite(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text, n, removed = zip(*map(rewritten, part.column(at).to_pylist(), part.column(len(keep)).to_pylist()), strict=True)
                columns = list(part.columns[: len(keep)])
                columns[at] = pa.array(text, type=part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=out.names)

    return by_merge(docs.select(*keep), gone.withColumnRenamed("doc_id", "__doc"), F.col("doc_id") == F.col("__doc"), "left").select(*keep, "__gone").mapInArrow(rewrite, out)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
