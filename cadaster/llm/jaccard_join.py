"""Operator 4: exact Jaccard join of word n-gram sets by universe partition.

Two documents link when the Jaccard similarity of their shingle sets reaches the threshold; the
result is each document's component, the least doc_id that links reach.

1. Documents with the same set are one class, by a 128-bit digest; copies are never paired.
2. A shingle found in one document only is in no intersection, so a document with too many of those
   links with nothing. They are counted over a quarter of all shingles first, which rules out most
   documents, and then over all shingles of those that are left. Nothing that links is ruled out.
3. Sets of like size meet in a size band. Sets within Hamming distance H split their tokens by hash
   into m segments; k of them are indexed with their one-deletion neighbourhoods, the others as they
   are. With 2k + (m - k) = H + 1 two sets that link share a key: were all indexed segments further
   apart than their keys reach, the distance would be H + 1. For each band m and k are the cheapest
   by a cost model of keys written and chance meetings, from the band's number of sets.
4. Each key's sets are compared with its least set, best-supported pairs first, then only pairs that
   are in different components by then, and last, for keys whose sets are still in different
   components, all pairs across components. Size and a parity sketch, which bounds the distance from
   below, rule pairs out; the full sets decide.

A group of n near copies thus costs about n comparisons, and no link between different sets is lost.

Edge cases: null and empty texts have empty sets and link with nothing; texts shorter than a shingle
have one element, the whole sequence; a null doc_id has no component (null) and links with nothing;
repeated rows of one doc_id are one document to its component and each is returned; columns other
than doc_id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import exp

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadaster.llm.components import between, unite
from cadaster.llm.shared import by_merge, passing, saved, split_join
from cadaster.llm.text import digest, mix, shingles, together

WORDS, THRESHOLD = 5, Fraction(80, 100)
#: One in so many shingles is counted in the first pass over all documents.
SAMPLED = 4
SKETCH_WORDS = 8
#: What a chance meeting costs, in keys.
MEETING = 20.0
#: Sets of other components that a key's sets meet there on average; keys where they would meet more use rare tokens, with the same links.
EACH_WITH_EACH = 64


# --- size bands -----------------------------------------------------------------------------------


def bands(longest: int, t: Fraction) -> list[tuple[int, int]]:
    """(least, greatest) size of each band: a set links within its own band and the next ones on each side."""
    out, least = [], 1
    while least <= longest:
        greatest = least * t.denominator // t.numerator
        out.append((least, greatest))
        least = greatest + 1
    return out


def distance(a: int, b: int, t: Fraction) -> int:
    """The greatest symmetric difference of linked sets of these sizes."""
    return (t.denominator - t.numerator) * (a + b) // (t.denominator + t.numerator)


def allocate(greatest: int, sets: int, t: Fraction) -> tuple[int, int]:
    """(m, k) of a band: m segments, k of them with one-deletion neighbourhoods; the cheapest by the cost model."""
    h = distance(greatest, greatest, t)

    def cost(k: int) -> float:
        m = h + 1 - k
        s = greatest / m
        alone, few = exp(-s), (1 + s) * exp(-s)  # a segment is empty; or has at most one token
        return m + k * s + MEETING * sets * ((m - k) * alone**2 + k * few**2)

    steps = sorted({round((h + 1) // 2 * i / 16) for i in range(17)})
    k = min(steps, key=cost)
    return h + 1 - k, k


def keys(tokens: np.ndarray, band: int, m: int, k: int) -> np.ndarray:
    """Index keys of a set in a band."""
    place = mix(tokens + np.uint64((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    segment = (place >> np.uint64(33)).astype(np.int64) % m
    value = mix(place ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = np.zeros(m, dtype=np.uint64)
    np.add.at(total, segment, value)
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band * 1_000_003 + 17))
    out = [mix(total ^ salt)]
    if k:
        own = segment < k
        out.append(mix((total[segment[own]] - value[own]) ^ salt[segment[own]]))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray) -> list[int]:
    """A bitmap in which each token flips a bit: sets differ in as many tokens at least as bitmaps do in bits."""
    at = (mix(tokens) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS)
    odd = np.bincount(at, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


# --- stages ---------------------------------------------------------------------------------------


def _digests(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, d1, d2: size and digest of every document's set."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            raws = b.column(1).to_pylist()
            for start, end in together(raws):
                at, tokens = shingles(raws[start:end], words)
                own = b"".join([digest(tokens[i:j].tobytes()) if j > i else bytes(16) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                d = np.frombuffer(own, dtype="<i8").reshape(-1, 2)
                columns = [b.column(0).slice(start, end - start), pa.array(np.diff(at).astype(np.int32)), *(pa.array(np.ascontiguousarray(d[:, i])) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "d1", "d2"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n int, d1 long, d2 long")


def _lonely(tokens: DataFrame) -> DataFrame:
    """doc_id, u: how many of the tokens (doc_id, token) of a document are in no other."""
    once = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("c")).where("c = 1")
    return once.groupBy("doc_id").agg(F.count("*").alias("u"))


def _some_tokens(docs: DataFrame, words: int) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            docs_, raws = b.column(0).to_numpy(), b.column(1).to_pylist()
            for start, end in together(raws):
                at, tokens = shingles(raws[start:end], words)
                some = tokens % np.uint64(SAMPLED) == 0
                own = np.repeat(docs_[start:end], np.diff(at))[some]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(tokens[some].view(np.int64))], names=["doc_id", "token"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, token long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n, tokens, sketch of the documents that have shingles."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            raws = b.column(1).to_pylist()
            for start, end in together(raws):
                at, tokens = shingles(raws[start:end], words)
                sketches = [parity(tokens[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.view(np.int64)))
                columns = [b.column(0).slice(start, end - start), pa.array(np.diff(at).astype(np.int32)), lists, pa.array(sketches, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "tokens", "sketch"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "id long, n int, tokens array<bigint>, sketch array<bigint>").where("n > 0")


def _index(sets: DataFrame, t: Fraction) -> DataFrame:
    """key, id for every key of every set."""
    import pyarrow as pa

    longest = sets.agg(F.max("n")).first()[0] or 0
    limits = bands(longest, t)
    edges = [a for a, _ in limits]
    # the size histogram has as many rows as there are bands
    band = F.size(F.filter(F.lit(edges), lambda a: a <= F.col("n"))) - 1 if edges else F.lit(0)
    counts = {r.band: r["count"] for r in sets.groupBy(band.alias("band")).count().collect()}
    plan = []
    for g in range(len(limits) + 1):
        greatest = limits[g][1] if g < len(limits) else limits[-1][1] if limits else 1
        plan.append(allocate(greatest, counts.get(g, 0) + counts.get(g - 1, 0), t))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, ids, found = b.slice(at, 256), [], []
                tokens = part.column(2)
                ends = tokens.offsets.to_numpy()
                flat = tokens.values.to_numpy().view(np.uint64)
                for i, (doc, n) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    own = int(np.searchsorted(edges, n, side="right")) - 1
                    for g in (own, own + 1):  # as the larger of a pair, and as the smaller
                        k = keys(flat[ends[i] : ends[i + 1]], g, *plan[g])
                        found.append(k)
                        ids.append(np.full(len(k), doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])

    return sets.select("id", "n", "tokens").mapInArrow(run, "key long, id long")


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b), a saved table, that link, by their full sets; a set that many are compared with is dealt out to them."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    both = by_merge(split_join(pairs.select("a", "b"), side("b"), "b", "a"), side("a"), "a")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    linked = common * (t.denominator + t.numerator) >= (F.col("n_a") + F.col("n_b")) * t.numerator
    return both.where(linked).select("a", "b")


def _may_link(t: Fraction):
    """Condition on n_a, n_b, sketch_a, sketch_b that every pair that links meets."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    most = F.floor((F.col("n_a") + F.col("n_b")) * (t.denominator - t.numerator) / F.lit(t.denominator + t.numerator))
    bits = sum((F.bit_count(F.get("sketch_a", i).bitwiseXOR(F.get("sketch_b", i))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (small * t.denominator >= large * t.numerator) & (bits <= most + 1)


def _across(left: DataFrame, right: DataFrame, by: str, t: Fraction) -> DataFrame:
    """a, b of the rows (by, id, root, n, sketch) of both sides that share `by`, are in different components and may link."""
    side = lambda rows, s: rows.select(by, *(F.col(c).alias(f"{c}_{s}") for c in ("id", "root", "n", "sketch")))
    both = side(left, "a").join(side(right, "b"), by)
    return both.where((F.col("root_a") < F.col("root_b")) & _may_link(t)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _rarest(near: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """token, id, root, n, sketch: of each set of near (id, root, n, sketch) as many of its rarest tokens as tell it from all that it does not link with.

    Tokens that one component alone holds are counted, but left out at the end, as they meet nothing.
    """
    tokens = by_merge(sets.select("id", "tokens"), near.select("id", "root", "n"), "id").select("id", "root", "n", F.explode("tokens").alias("token"))
    tokens = saved(tokens, "tokens")
    held = saved(tokens.groupBy("token").agg(F.count("*").alias("sets"), (F.min("root") < F.max("root")).alias("meets")), "held")
    place = F.row_number().over(Window.partitionBy("id").orderBy("sets", "token"))
    spare = F.floor(F.col("n") * (t.denominator - t.numerator) / F.lit(t.denominator))
    first = split_join(tokens, held, "token", "id").withColumn("place", place).where((F.col("place") <= spare + 1) & F.col("meets"))
    return saved(by_merge(first.select("token", "id"), near, "id"), "rarest")


def link(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    t = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    keep: list[DataFrame] = []
    with passing(keep):
        digests = saved(_digests(docs, words), "digests")
        classes = saved(digests.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")

        known = docs.where("doc_id is not null")
        lonely = saved(_lonely(_some_tokens(known, words)), "lonely")
        may = (F.col("n") - F.coalesce("u", F.lit(0))) * t.denominator >= F.col("n") * t.numerator
        left = by_merge(classes, lonely.withColumnRenamed("doc_id", "rep"), "rep", "left").where(may).select(F.col("rep").alias("doc_id"))
        sets = saved(_sets(by_merge(known, left, "doc_id", "left_semi"), words), "sets")
        lonely = _lonely(sets.select(F.col("id").alias("doc_id"), F.explode("tokens").alias("token")))
        wanted = saved(sets.select("id", "n").join(lonely.withColumnRenamed("doc_id", "id"), "id", "left").where(may).select("id"), "wanted")
        sets = saved(sets.join(wanted, "id", "left_semi"), "sets")

        index = saved(_index(sets, t), "index")
        least = saved(index.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last"), "least")
        star = index.join(least, "key").where("id <> rep").groupBy(F.col("id").alias("a"), F.col("rep").alias("b")).agg(F.count("*").alias("shared"))
        star = saved(star, "star")
        labels = None
        if not star.isEmpty():
            best = saved(star.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b")), "best")
            labels = unite(labels, saved(_verify(best, sets, t), "verified"))
            sketch = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
            apart = between(labels, star.select("a", "b")).where("a_root <> b_root").select("a", "b").join(sketch("a"), "a").join(sketch("b"), "b").where(_may_link(t))
            labels = unite(labels, saved(_verify(saved(apart.select("a", "b"), "apart"), sets, t), "verified"))
            # keys whose sets are still in different components
            named = index.join(least.select("key"), "key", "left_semi")
            if labels is None:
                named = named.withColumn("root", F.col("id"))
            else:
                named = named.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
            named = saved(named, "named")
            # sets of a key in one component meet nothing there; a set of another component meets them all
            shares = named.groupBy("key", "root").agg(F.count("*").cast("double").alias("c")).groupBy("key").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("within"))
            meetings = F.col("c") * F.col("c") - F.col("within")
            mixed = saved(shares.where(meetings > 0).select("key", (meetings > EACH_WITH_EACH * F.col("c")).alias("large")), "mixed")
            open_ = saved(named.join(mixed, "key").join(sets.select("id", "n", "sketch"), "id"), "open")
            few, near = open_.where("not large"), open_.where("large").select("id", "root", "n", "sketch")
            across = _across(few, few, "key", t)
            if not near.isEmpty():
                rarest = _rarest(saved(near.dropDuplicates(["id"]), "near"), sets, t)
                across = across.unionByName(_across(rarest, rarest, "token", t))
            across = across.distinct()
            labels = unite(labels, saved(_verify(saved(across, "across"), sets, t), "verified"))
        if labels is not None:
            own = labels.select(F.col("node").alias("rep"), F.col("root").alias("component"))
            classes = saved(classes.join(own, "rep", "left").withColumn("rep", F.coalesce("component", "rep")).drop("component"), "classes")
        keep += [digests, classes]
    # a row without a class (no shingles, no doc_id) finds none and stands alone
    found = digests.join(classes, ["n", "d1", "d2"], "left")
    own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("rep"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
