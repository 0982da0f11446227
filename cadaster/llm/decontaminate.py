"""Operator 7: benchmark decontamination with an Aho-Corasick automaton over words.

Texts and benchmark items are normalised alike: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
A pattern is a window of 13 consecutive words of an item; an item of fewer words, but not none, is
one pattern. The automaton reads each text's words once; a word inside any occurrence is hit, and
each word's place in the original text is known.

The items are the only data sent to every executor, as texts; a Python worker builds the automaton
once and keeps it, and one more, for its later tasks. Its size is checked before: an automaton has MOST_STATES states
at most (about 60 bytes each), and a benchmark that needs more is scanned for in several passes that
carry the hits along, so nothing is left out; an item whose words alone make more is one automaton.

Edge cases: null or empty texts have no words; null item texts have no patterns; a null item_id
counts as ''; repeated items count once; repeated documents are each judged; other columns of the
documents pass through untouched; an empty table of either kind gives rows without hits.
"""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import map_texts
from cadaster.llm.text import LOWER

WINDOW = 13
#: States of one automaton: each word of a window makes one at most.
MOST_STATES = 4_000_000
#: Per byte: A-Z lower-cased, word bytes kept, all else a space.
NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in LOWER)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def build(items: list[tuple[str, bytes]], window: int = WINDOW):
    """(automaton over word numbers, word numbers) of items (id, text); 0 is any word that no item has.

    A window's value is its length and the sorted ids of the items that hold it.
    """
    import ahocorasick

    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for item, raw in sorted(items):
        words = tuple([numbers.setdefault(w, len(numbers) + 1) for w in normal_words(raw)])
        for at in range(max(1, len(words) - window + 1) if words else 0):
            key = words[at : at + window]
            held = automaton.get(key, (0, ()))[1]
            if not held or held[-1] != item:
                automaton.add_word(key, (len(key), (*held, item)))
    if numbers:
        automaton.make_automaton()
    return automaton, numbers


#: The automata that this Python worker built last, by the names of their items; workers take turns between passes.
_kept: dict[str, tuple] = {}
KEPT = 2


def kept(name: str, items):
    """build() of broadcast items, once a worker."""
    if name not in _kept:
        while len(_kept) >= KEPT:
            del _kept[next(iter(_kept))]
        _kept[name] = build(items.value)
    return _kept[name]


def hits(raw: bytes, automaton, numbers: dict[bytes, int]) -> tuple[int, np.ndarray, set[str]]:
    """(words of the text, which of them are hit, items found)."""
    words = normal_words(raw)
    covered, found = np.zeros(len(words) + 1, dtype=np.int32), set()
    if numbers:
        for end, (n, items) in automaton.iter(tuple([numbers.get(w, 0) for w in words])) if words else ():
            covered[end - n + 1] += 1
            covered[end + 1] -= 1
            found.update(items)
    return len(words), np.cumsum(covered[:-1]) > 0, found


def spans_of(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point offsets in the original text of each run of hit words."""
    at = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    return [(int(points[at[a][0]]), int(points[at[b - 1][1]])) for a, b in runs]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (default: all) with `contamination`: n_words, hit_words, items, spans.

    hit_words: numbers of the hit words, from 0. items: ids of the items found, sorted as strings.
    spans: (start, end) code point offsets in the original text of each run of hit words. An older
    column named contamination is replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != "contamination"]
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    n = F.regexp_count(F.lower(F.col("text").cast("string")), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"))
    states = items.agg(F.sum(F.greatest(n - WINDOW + 1, F.lit(1)) * F.least(n, F.lit(WINDOW)))).first()[0] or 0
    parts = 1 + states // MOST_STATES
    rows, old = docs.select(*dict.fromkeys([*keep, text])), None
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in own.collect()])

        def per_text(sent=sent, name=uuid4().hex):
            automaton, numbers = kept(name, sent)

            def one(raw):
                if not raw:
                    return 0, [], [], []
                n, hit, found = hits(raw, automaton, numbers)
                return n, np.flatnonzero(hit).tolist(), sorted(found), spans_of(raw, hit) if found else []

            return one

        names = f"__n_{part}", f"__hit_{part}", f"__items_{part}", f"__spans_{part}"
        fields = "{} int, {} array<int>, {} array<string>, {} array<struct<start:int,end:int>>".format(*names)
        rows = map_texts(rows, rows.columns, fields, per_text, text)
        now = [F.col(c) for c in names]
        old = now if old is None else [now[0], *(F.array_union(a, b) for a, b in zip(old[1:], now[1:], strict=True))]
    n, hit, found, spans = old
    return rows.select(*keep, F.struct(n.alias("n_words"), F.array_sort(hit).alias("hit_words"), F.array_sort(found).alias("items"), F.array_sort(spans).alias("spans")).alias("contamination"))


def contaminated(c: Column) -> Column:
    """A text is contaminated if words are hit, and they are a twentieth of it at least."""
    n_hit = F.size(c["hit_words"])
    return (n_hit > 0) & (20 * n_hit >= c["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    kept = docs.columns
    return scan(docs.withColumnRenamed("contamination", "__contamination"), benchmark).where(~contaminated(F.col("contamination"))).drop("contamination").toDF(*kept)


def digest(scanned: DataFrame) -> DataFrame:
    c = F.col("contamination")
    return scanned.select(
        "doc_id",
        c["n_words"].cast("long").alias("n_words"),
        F.size(c["hit_words"]).cast("long").alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(c).alias("contaminated"),
    )
