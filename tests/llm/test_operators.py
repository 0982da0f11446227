"""Each operator against its SQL on the given tables, and against brute force on small ones."""

import contextlib
import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadaster.llm import chat_format, decontaminate, jaccard_join, line_crf, line_dedup, packing, quality_bt, queries, shared, substring_dedup, text, toxicity_ftrl, url_filter
from cadaster.llm.shared import held_out, saved
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Near and exact copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(5)
    out = {}
    for base in range(12):
        w = words(rng, rng.choice([3, 5, 12, 60, 90, 200]))
        for copy in range(4):
            v = list(w)
            for _ in range(copy * rng.randrange(0, 3)):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], ["x"], ["y", "z"]])
            out[base * 10 + copy] = " ".join(v)
    passage = " ".join(words(rng, 60))
    for i in range(8):
        out[200 + i] = f"{' '.join(words(rng, 30 + i))} {passage}\n{' '.join(words(rng, 20))}"
    out |= {300: None, 301: "", 302: " \n\t ", 303: "un", 304: "É à\x0bmots  Mots", 305: "long " * 30_000 + "end", 306: "\n".join(["same line of eight words to be cut"] * 5 + ["Same line of eight words to be kept", "other"])}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def hash_of(text):
    return hashlib.sha256(text.encode()).hexdigest()


def found_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings_brute_force(docs, texts):
    first, tokens = {}, {i: found_words(t) for i, t in texts.items()}
    for i in sorted(tokens):
        for at in range(len(tokens[i]) - 49):
            first.setdefault(tuple(tokens[i][at : at + 50]), i)
    for r in substring_dedup.digest(substring_dedup.dedup(docs)).collect():
        w, gone = tokens[r.doc_id], set()
        for at in range(len(w) - 49):
            if first[tuple(w[at : at + 50])] < r.doc_id:
                gone |= set(range(at, at + 50))
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hash_of(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("k, t", [(4, Fraction(85, 100)), (5, Fraction(80, 100)), (2, Fraction(1, 2))])
def test_jaccard_brute_force(docs, texts, k, t):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, k, t).collect()}
    assert got == plain.components(texts, k, t)


@pytest.mark.parametrize("most", [0, 8, 10**9])
def test_jaccard_large_keys(docs, texts, monkeypatch, most):
    """The same links, whichever keys' sets are compared each with each and whichever meet by rare tokens."""
    monkeypatch.setattr(jaccard_join, "EACH_WITH_EACH", most)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, 2, Fraction(1, 2)).collect()}
    assert got == plain.components(texts, 2, Fraction(1, 2))


def test_jaccard_pages_of_a_template(spark, monkeypatch):
    """Pages just below the threshold meet only those that they share rare words with; copies among them are found."""
    n, t = 150, Fraction(80, 100)
    part = lambda i: [f"own{i % n}-{j}" for j in range(15)]
    pages = {i: [f"word{j}" for j in range(100)] + part(i) + part(i + 1) for i in range(n)}
    pages |= {1000 + i: [*pages[i][:-1], f"own{(i + 9) % n}-0"] for i in range(0, n, 10)}
    texts = {i: " ".join(w) for i, w in pages.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    met = {}

    def link(most):
        monkeypatch.setattr(jaccard_join, "EACH_WITH_EACH", most)
        monkeypatch.setattr(jaccard_join, "saved", lambda df, name: met.update({(most, name): shared.saved(df, name)}) or met[most, name])
        return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, 1, t).collect()}

    monkeypatch.setattr(jaccard_join, "_may_link", lambda t: F.lit(True))
    want = plain.components(texts, 1, t)
    assert want[1010] == (130, 10) and want[11] == (130, 11)
    monkeypatch.setattr(jaccard_join, "passing", lambda keep: contextlib.nullcontext())
    assert link(8) == want and met[8, "across"].count() <= 4 * n
    assert link(10**9) == want and met[10**9, "across"].count() > 10 * n


def test_segments_meet_within_the_distance():
    """Sets within a band's distance share a key, whatever the allocation."""
    rng = np.random.default_rng(3)
    t = Fraction(80, 100)
    for greatest in (8, 30, 120):
        h = jaccard_join.distance(greatest, greatest, t)
        for k in range(0, (h + 1) // 2 + 1):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, greatest, dtype=np.uint64)
                out = rng.integers(0, h + 1)
                b = np.concatenate((a[out:], rng.integers(0, 1 << 63, rng.integers(0, h - out + 1), dtype=np.uint64)))
                assert len(np.intersect1d(jaccard_join.keys(a, 1, h + 1 - k, k), jaccard_join.keys(b, 1, h + 1 - k, k)))


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() & 1] for i in range(n)]


def test_regular_patterns_do_not_collide(spark):
    """Sequences on which polynomials modulo a power of two agree, as words, lines, windows and sets."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    for t in (one, two):
        assert len(text.word_hashes(*text.spans("".join(t).encode(), text.SPACED))) == 1
    whole = [text.word_hashes(*text.spans("".join(t).encode(), text.SPACED))[0] for t in (one, two)]
    runs = [text.window_hashes(text.word_hashes(*text.spans(" ".join(t).encode(), text.SPACED)), 2048)[0] for t in (one, two)]
    assert whole[0] != whole[1] and runs[0] != runs[1]
    rows = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, "".join(one)), (4, "".join(two))], "doc_id long, text string")
    assert all(r.n_removed == 0 and r.n_lines == 1 for r in line_dedup.dedup(rows).collect())
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup(rows, 2048).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r.component_id == r.doc_id for r in jaccard_join.link(rows, 2048).collect())


def test_word_and_run_hashes():
    rng = random.Random(9)
    for size in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 300):
        made = {bytes(rng.choice(b"ab") for _ in range(size)) for _ in range(300)}
        assert len({int(text.word_hashes(*text.spans(w, text.SPACED))[0]) for w in made}) == len(made)
        assert {tuple(text.word_hashes(*text.spans(b"x " + w + b" y", text.SPACED)))[1] for w in made} == {text.word_hashes(*text.spans(w, text.SPACED))[0] for w in made}
    w = text.word_hashes(*text.spans(" ".join(words(rng, 500)).encode(), text.SPACED))
    for kind in ("word", "check"):
        runs = text.Runs(w, kind)
        for start, end in ((0, 500), (3, 40), (77, 78), (200, 260)):
            alone = text.Runs(w[start:end], kind)
            assert runs.between(np.array([start]), np.array([end])) == alone.between(np.array([0]), np.array([end - start]))
            shorter = [text.Runs(np.delete(w[start:end], i), kind).between(np.array([0]), np.array([end - start - 1]))[0] for i in range(end - start)]
            at = np.arange(start, end)
            assert runs.without(at, np.full(len(at), start), np.full(len(at), end)).tolist() == shorter


def test_blocks_lose_no_repeat(spark):
    """Anchors in two documents pass every block's sketch, however few its counters."""
    rng = random.Random(4)
    passage = words(rng, 70, 9999)
    rows = [(i, " ".join(words(rng, 80, 9999) + (passage if i % 7 == 0 else []))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.col("text").cast("binary").alias("text"))
    for blocks in (1, 5, 64):
        dealt = saved(substring_dedup.anchors_by_block(docs, blocks), "anchors")
        found = {r.doc_id: set(r.anchors) for r in substring_dedup.estimated_repeated(dealt, substring_dedup.sketch(dealt)).collect()}
        every = Counter(h for r in dealt.collect() for h in r.hashes)
        assert {h for hs in found.values() for h in hs} >= {h for h, n in every.items() if n > 1} and set(found) >= {i for i, _ in rows if i % 7 == 0}


def test_passing_tables_go(spark):
    """Saved tables that a result is not read from are deleted, at every depth; kept ones pass to the scope around."""
    import os

    there = lambda t: os.path.exists(t.saved_at.removeprefix("file:"))
    keep, inner_keep = [], []
    with shared.passing(keep):
        a = saved(spark.range(2), "a")
        with shared.passing(inner_keep):
            b, c = saved(spark.range(3), "b"), saved(spark.range(4), "c")
            inner_keep.append(c)
        assert there(a) and not there(b) and there(c)
        keep.append(a)
    assert there(a) and not there(c) and a.count() == 2
    before = saved(jaccard_join.link(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")), "result")
    assert sorted(r.component_id for r in before.collect()) == [1, 1, 3]


def test_split_join(spark, monkeypatch):
    """A hot key's rows meet copies of its row; the result is a plain join's."""
    monkeypatch.setattr(shared, "PER_COPY", 3)
    many = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(40)], "a long, b long")
    one = spark.createDataFrame([(i, f"v{i}") for i in range(60)], "b long, v string")
    got = Counter((r.a, r.b, r.v) for r in shared.split_join(many, one, "b", "a").collect())
    assert got == Counter((r.a, r.b, r.v) for r in many.join(one, "b").collect()) and max(got.values()) == 1


@pytest.mark.parametrize("least", [2, 3, 5, 8])
def test_edited_lines_meet(least):
    """Lines one edit apart share a pair of thirds, whatever their length."""
    rng = random.Random(least)
    keys = lambda w: {int(k[0]) for k, there in line_dedup.thirds_of(text.Runs(text.word_hashes(*text.spans(" ".join(w).encode(), text.SPACED))), np.array([0]), np.array([len(w)])) if there[0]}
    for n in [*range(least, 40), 70, 200, 600]:
        a, at = words(rng, n, 50), rng.randrange(n)
        for b in (a[:at] + a[at + 1 :], a[:at] + ["new"] + a[at + 1 :], a[:at] + ["new"] + a[at:]):
            if len(b) >= least:
                assert keys(a) & keys(b), (n, at)


def test_line_edits(spark):
    base = "one two three four five six seven eight nine".split()
    cases = {1: base, 2: [*base[:4], "X", *base[5:]], 3: base[1:], 4: [*base, "ten"], 5: ["X", *base[1:8], "Y"], 6: base[:7], 7: [*base[:4], "X", *base[5:8], "Z"]}
    rows = spark.createDataFrame([(i, " ".join(w) + f"\nfor {i} only") for i, w in cases.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(rows).collect()}
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and line_dedup.within_one(a, b) and min(len(a), len(b)) >= line_dedup.MIN_WORDS
    for i, w in cases.items():
        low = [x.lower() for x in w]
        gone = any(j < i and (near(low, [y.lower() for y in v])) for j, v in cases.items())
        assert (got[i].split("\n")[0] != " ".join(w)) == gone, i


def test_lines_brute_force(docs, texts):
    kept = plain.kept_lines(texts, line_dedup.MIN_WORDS)
    for r in line_dedup.dedup(docs).collect():
        assert (r.text or "") == "\n".join(kept[r.doc_id][1]) and r.n_lines == kept[r.doc_id][0], r.doc_id


def test_short_lines_by_parameter(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e"), (2, "a x c\nd"), (3, "a b c q\nd e"), (4, "z b\nz")], "doc_id long, text string")
    for least in (2, 3, 4, 5):
        want = plain.kept_lines({r.doc_id: r.text for r in rows.collect()}, least)
        assert {r.doc_id: r.text for r in line_dedup.dedup(rows, least).collect()} == {i: "\n".join(x) for i, (_, x) in want.items()}, least


def test_decontamination_brute_force(spark, docs, texts):
    items = {1: " ".join(texts[200].split()[30:52]), 2: "W1 w2", 3: "", 4: None, 5: texts[0], 6: "un"}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    wanted = plain.contamination(texts, items.items())
    scanned = decontaminate.scan(docs, benchmark)
    spans = {r.doc_id: r.contamination for r in scanned.collect()}
    for r in decontaminate.digest(scanned).collect():
        w, hit, found = wanted[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), plain.is_contaminated(w, hit))
        assert r.items_sha256 == hash_of(",".join(found))
        marked = [x for s in spans[r.doc_id].spans for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain.lower(texts[r.doc_id][s.start : s.end]))]
        assert marked == [w[i] for i in sorted(hit)]


def test_large_benchmark_is_scanned_in_parts(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(60)], "item_id long, text string")
    whole = {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, benchmark)).collect()}
    monkeypatch.setattr(decontaminate, "MOST_STATES", 30)
    assert whole == {r.doc_id: r for r in decontaminate.digest(decontaminate.scan(docs, benchmark)).collect()}


def test_packing(docs, texts):
    rows = packing.pack_documents(docs, (16, 64, 256)).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == len(found_words(t)) and [r.start for r in own] == [256 * k for k in range(len(own))]
    bins = {}
    for r in rows:
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.n_tokens for x in held[:k]) for k in range(len(held))]
        used = sum(r.n_tokens for r in held)
        assert {r.capacity for r in held} == {min(c for c in (16, 64, 256) if c >= used)}


def test_packing_by_plain_best_fit():
    rng = random.Random(8)
    for n in [*range(1, 12), 40, 120]:
        for _ in range(12):
            sizes = sorted((rng.randrange(1, 65) for _ in range(n)), reverse=True)
            bins, offsets, capacity = packing.pack(np.array(sizes), (8, 16, 40, 64), 3)
            assert list(zip(bins.tolist(), offsets.tolist(), capacity.tolist(), strict=True)) == plain.best_fit(sizes, (8, 16, 40, 64), 3)


def test_packing_is_near_the_least_cost():
    """Against every way to put a few pieces together: at most a fifth dearer, each time."""
    rng, capacities, overhead = random.Random(3), (16, 32, 64), 4

    def ways(sizes):
        if not sizes:
            yield []
            return
        for rest in ways(sizes[1:]):
            yield [[sizes[0]], *rest]
            for i in range(len(rest)):
                yield [*rest[:i], [sizes[0], *rest[i]], *rest[i + 1 :]]

    cost = lambda groups: sum(min((c for c in capacities if c >= sum(g)), default=10**9) + overhead for g in groups)
    for _ in range(25):
        sizes = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 8))), reverse=True)
        bins, _, capacity = packing.pack(np.array(sizes), capacities, overhead)
        first = np.unique(bins, return_index=True)[1]
        assert (capacity[first] + overhead).sum() <= 1.2 * min(map(cost, ways(sizes))) + 4, sizes


def test_packing_is_tight():
    sizes = np.sort(np.random.default_rng(1).integers(1, 900, 4000))[::-1]
    bins, _, capacity = packing.pack(sizes)
    total = sum(capacity[np.unique(bins, return_index=True)[1]])
    assert total <= 1.01 * sizes.sum() + 8192


def test_base_rules_brute_force(docs, texts):
    judged = line_crf.judge(docs, line_crf.fit(docs))
    for r in line_crf.digest(judged).collect():
        t = texts[r.doc_id] or ""
        w = found_words(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if found_words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        field = line_crf.Field(rng.normal(size=(line_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, line_crf.N_FEATURES))
        score = lambda s: sum((x[i] @ field.emit)[s[i]] for i in range(n)) + sum(field.move[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        assert tuple(field.viterbi(x)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_rules_keep_good_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = line_crf.digest(line_crf.judge(docs, line_crf.fit(docs))).join(labels, "doc_id").where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.95 * good.count()


def test_rules_reject_boilerplate(spark, sf_dir):
    """Pages of notices and menus go, prose stays; a document's share of content is that of the words on its content lines."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prose = [" ".join(f"{w}{i}{k}" for k, w in enumerate("the harbour was quiet when boats came in and nets were laid out along the wall to dry under a pale sun".split())) + "." for i in range(6)]
    notices = [f"COPYRIGHT {i} ALL RIGHTS RESERVED | HOME | ABOUT | LOGIN {i} | SUBSCRIBE NOW !!! ### {i}" for i in range(12)]
    rows = [(1, "\n".join(prose)), (2, "\n".join(notices)), (3, "\n".join(prose[:4] + notices[:2])), (4, "\n".join(prose[:1] + notices))]
    judged = line_crf.judge(spark.createDataFrame(rows, "doc_id long, text string"), line_crf.fit(known)).collect()
    assert {r.doc_id: r.rules.kept for r in judged} == {1: True, 2: False, 3: True, 4: False}
    for r in judged:
        lines = [len(x.split()) for x in r.text.split("\n")]
        share = sum(lines[i] for i in r.rules.content_lines) / sum(lines)
        assert r.rules.content_share == pytest.approx(share) and r.rules.kept == (not r.rules.base_failed and share >= line_crf.CONTENT_SHARE)


def test_bad_documents_are_rejected(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    judged = line_crf.digest(line_crf.judge(docs, line_crf.fit(docs))).join(labels, "doc_id").where("NOT base_failed")
    bad = judged.where("quality = 0")
    assert bad.where("NOT kept").count() >= 0.7 * bad.count() > 0


def test_the_field_is_fitted_to_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "SAMPLE", 3)
    seen = []
    monkeypatch.setattr(line_crf, "fit_field", lambda found: seen.append(len(found)))
    line_crf.fit(spark.createDataFrame([(i, "same\ntext") for i in range(20)] + [(50, "one"), (51, "two"), (None, "three")], "doc_id long, text string"))
    assert seen == [3]
    x = np.arange(200.0)[:, None]
    starts = {int(line_crf.some_lines(x, str(i).encode())[0, 0]) for i in range(50)}
    assert len(line_crf.some_lines(x, b"x")) == line_crf.SAMPLE_LINES and len(starts) > 20 and len(line_crf.some_lines(x[:5], b"x")) == 5


@pytest.mark.parametrize("name, label, least", [("op2_quality_bt", "quality", 0.95), ("op5_toxicity_ftrl", "toxic", 0.75)])
def test_held_out_ranking(spark, sf_dir, name, label, least):
    """Rows that no label was learned from are ranked well; predictions follow scores."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.queries()[name](spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    cut = {"op2_quality_bt": 0.3, "op5_toxicity_ftrl": 0.7}[name]
    assert ((rows.score >= cut) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    held = rows[rows.held_out]
    good, bad = held[held[label] == 1].score.to_numpy(), held[held[label] == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean() >= least


def sampled(spark, sf_dir, label, keep):
    """(text, label) of the rows that may be learned from, in the sample's order."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where(keep).withColumn("h", F.xxhash64("doc_id", F.lit(17))).orderBy("h", "doc_id")
    return docs, labels, [(r.text, r[label]) for r in rows.collect()]


def test_bradley_terry_brute_force(spark, sf_dir):
    """The weights are where the penalised logistic loss of all pairs is least; the cut is the plain weighted quantile; scores follow."""
    keep = ~held_out(F.col("doc_id"), 5, 0)
    docs, labels, rows = sampled(spark, sf_dir, "quality", keep)
    model = quality_bt.fit(docs, labels, keep)
    z = [np.clip((np.array(quality_bt.features((t or "").encode())) - model.mean) / model.scale, -8, 8) for t, _ in rows]
    good, bad = ([x for x, (_, y) in zip(z, rows, strict=True) if y == k] for k in (1, 0))
    gradient = -quality_bt.L2 * model.weights
    for k in range(quality_bt.PAIRS_PER_ROW * max(len(good), len(bad))):
        d = good[k % len(good)] - bad[(k + k // len(good) * 7 + k // len(bad)) % len(bad)]
        gradient = gradient + d / (1 + np.exp(d @ model.weights))
    assert np.abs(gradient).max() < 1e-3
    strengths = sorted((float(x @ model.weights), 1 / len(rows)) for x in z)
    share, seen, before = len(bad) / len(rows), 0.0, None
    for strength, weight in strengths:
        seen += weight
        if seen >= share - 1e-9:
            break
        before = strength
    assert model.cut == pytest.approx((strength + (strength if before is None else before)) / 2)
    for r in quality_bt.score(docs, model).collect():
        x = np.clip((np.array(quality_bt.features((r.text or "").encode())) - model.mean) / model.scale, -8, 8) @ model.weights
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(x - model.cut + np.log(0.3 / 0.7), -40, 40))))


def test_quantile_counts_what_rows_stand_for():
    strength, share = np.array([0.0, 1.0, 2.0, 10.0]), 0.75
    assert quality_bt.quantile(strength, np.array([0.375, 0.375, 0.125, 0.125]), share) == 0.5
    assert quality_bt.quantile(strength, np.full(4, 0.25), 0.5) == 0.5


def test_ftrl_brute_force(spark, sf_dir):
    """The same weights as a learner of dictionaries, one coordinate at a time."""
    keep = ~held_out(F.col("doc_id"), 3, 1)
    docs, labels, rows = sampled(spark, sf_dir, "toxic", keep)
    top, z, n = 1 << toxicity_ftrl.BITS, Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == top else toxicity_ftrl.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity_ftrl.BETA + n[i] ** 0.5) / toxicity_ftrl.ALPHA + toxicity_ftrl.L2)

    seen = [([*sorted(set(toxicity_ftrl.buckets((t or "").encode()).tolist())), top], y) for t, y in rows]
    for _ in range(toxicity_ftrl.PASSES):
        for at, y in seen:
            x = {i: 1.0 if i == top or i < top // 2 else toxicity_ftrl.PAIR_VALUE for i in at}
            w = {i: weight(i) for i in at}
            off = 1 / (1 + np.exp(-np.clip(sum(w[i] * x[i] for i in at), -35, 35))) - y
            for i in at:
                g = off * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity_ftrl.ALPHA * w[i]
                n[i] += g * g
    fitted = toxicity_ftrl.fit(docs, labels, keep)
    want = {i: weight(i) for i in z if weight(i)}
    assert fitted.keys() == want.keys() and all(fitted[i] == pytest.approx(want[i], rel=1e-6) for i in want)
    for r in toxicity_ftrl.score(docs, fitted).limit(50).collect():
        at = {*toxicity_ftrl.buckets((r.text or "").encode()).tolist(), top}
        margin = sum(want.get(i, 0.0) * (1.0 if i == top or i < top // 2 else toxicity_ftrl.PAIR_VALUE) for i in at)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def test_a_bound_on_learned_features(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    monkeypatch.setattr(toxicity_ftrl, "MOST_FEATURES", 0)
    assert toxicity_ftrl.fit(docs, labels, F.lit(True)) == {}


def test_scores_ignore_identity(spark, sf_dir):
    """The same texts under other ids, languages and sources score the same."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_bt.fit(docs, labels, F.lit(True))
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "lang": F.lit("zz"), "source": F.lit("q"), "score": F.lit(9)})
    a = {r.doc_id: r.score for r in quality_bt.score(docs, model).collect()}
    assert {r.doc_id - 1_000_000: r.score for r in quality_bt.score(other, model).collect()} == a


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<|turn|>\\", "a]b\\e\nc", "<\\/s>", "", None, "é" * 10_000]
    roles = ["user", "user", "assistant", "us]er", None, "assistant", "assistant", "sys\\e", "tool"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, hard, strict=True))] + [(None, 0, "user", "x"), (2, 0, "assistant", "twice"), (2, 0, "assistant", "twice")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    parsed = {r.conv_id: r for r in chat_format.parse_formatted(chat_format.format_conversations(table)).collect()}
    assert [(t.role, t.text) for t in parsed[1].read_turns] == [(r or "", t or "") for r, t in zip(roles, hard, strict=True)]
    assert [t.text for t in parsed[2].read_turns] == ["twice", "twice"] and len(parsed[2].messages) == 1
    loss = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.digest(chat_format.format_conversations(table)).collect()}
    said = "".join(t or "" for r, t in zip(roles, hard, strict=True) if r == "assistant")
    assert loss[1] == (len(said), hash_of(said))
    for r in parsed.values():
        for s in r.loss_spans:
            assert not any(c in r.formatted[s.start : s.start + s.length] for c in chat_format.CONTROL)


def test_long_conversations(spark):
    """Offsets over many turns and many blocks of text, outside the basic plane too."""
    rng = random.Random(6)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a", "\U0001F600é", "x\\"]) * rng.randrange(0, 400)) for i in range(700)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    text_, spans = out.formatted, out.loss_spans
    said = [t.replace("\\", "\\\\") for _, _, r, t in rows if r == "assistant"]
    assert [text_[s.start : s.start + s.length] for s in spans] == said
    digest = chat_format.digest(spark.createDataFrame([out])).first()
    assert digest.loss_sha256 == hash_of("".join(t for _, _, r, t in rows if r == "assistant")) and digest.n_turns == 700


def test_url_edge_cases(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, None)], "page_id long, url string")
    weights = url_filter.fit(url_filter.labelled(spark))
    assert url_filter.judge(pages.where("false"), weights).count() == 0
    rows = url_filter.judge(pages, weights).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2].host == rows[2].path == ""
    tie = (("allow", "a.org", "/x"), ("block", "a.org", "/x"))
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 1"), weights, tie).collect()} == {"block"}
    own = url_filter.fit(spark.createDataFrame([("http://good.net/a", 0.0), ("http://bad.net/b", 1.0)], "url string, y double"))
    judged = url_filter.judge(spark.createDataFrame([(1, "http://bad.org/b"), (2, "http://good.org/a")], "page_id long, url string"), own).collect()
    assert [r.verdict for r in sorted(judged)] == ["block", "allow"]


def test_url_model_does_not_see_judged_pages(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select(F.substring_index("url", "://", -1).alias("u"))
        assert pages.where(F.col("u").isin(url_filter.KEEP + url_filter.LEAVE)).count() == 0


def test_url_rules(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "https://EXAMPLE.com/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"), "http://b.example.com/en/": ("b.example.com", "/en/", "example.com/en/", "block"),
        "http://m.www.example.com/en/2#f": ("m.www.example.com", "/en/2", "www.example.com/en/", "allow"), "http://x.net/fr/": ("x.net", "/fr/", "net/fr/", "block"), "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://cheap-pills.example.org/en/1": ("cheap-pills.example.org", "/en/1", None, "block"), "http://a.com": ("a.com", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "http://?x": ("", "", None, None),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.fit(url_filter.labelled(spark))).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want[:3] and got[i].verdict in ((want[3],) if want[3] else ("allow", "block"))


def test_odd_tables(spark, docs):
    """Null ids, repeated rows, empty tables and clashing columns."""
    extra = docs.withColumns({c: F.lit("clash") for c in ("score", "contamination", "rules", "n_words", "n_lines", "n_removed", "id", "n", "h", "component_id", "slot")})
    odd = extra.unionByName(extra.where("doc_id = 200")).unionByName(extra.limit(1).withColumns({"doc_id": F.lit(None).cast("long")}))
    n = odd.count()
    empty, none = odd.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "w1 w2 w3"), (1, None)], "item_id long, text string")
    every = {
        "bt": lambda d: quality_bt.score(d, quality_bt.fit(d, none, F.lit(True))), "ftrl": lambda d: toxicity_ftrl.score(d, toxicity_ftrl.fit(d, none, F.lit(True))),
        "crf": lambda d: line_crf.judge(d, line_crf.fit(d)), "jaccard": jaccard_join.link, "decontaminate": lambda d: decontaminate.scan(d, items), "no items": lambda d: decontaminate.scan(d, items.where("false")),
        "lines": line_dedup.dedup, "substrings": substring_dedup.dedup,
    }
    for name, f in every.items():
        assert f(odd).count() == n, name
        assert f(empty).count() == 0, name
    assert packing.pack_documents(odd).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and packing.pack_documents(empty).count() == 0
    assert {r.score for r in every["bt"](odd).collect()} == {0.5} == {r.score for r in every["ftrl"](odd).collect()}
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    chats = spark.createDataFrame([(None, 0, "user", "x", 1), (None, 0, "user", "x", 1)], "conv_id long, turn long, role string, text string, messages int")
    formatted = chat_format.format_conversations(chats).collect()
    assert [(r.conv_id, len(r.messages), r.formatted) for r in formatted] == [(None, 1, "<s>[user]x<|turn|>x</s>")]
    null = [r for r in jaccard_join.link(odd).collect() if r.doc_id is None]
    assert [r.component_id for r in null] == [None]


# --- what was not tested before ----------------------------------------------------------------------


def test_no_module_defines_a_name_twice():
    import ast
    from pathlib import Path

    for path in Path(quality_bt.__file__).parent.glob("*.py"):
        names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef)))
        assert not [n for n, k in names.items() if k > 1], path


def test_bradley_terry_past_its_bound(spark, monkeypatch):
    """With few rows sampled the cut is still the labels' share: a sampled row counts as many as it stands for."""
    rng = random.Random(3)
    texts_ = [(i, " ".join(words(rng, 60 if i % 4 else 12)) + ("." if i % 4 else " ###"), int(i % 4 > 0)) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts_], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts_], "doc_id long, quality int")
    monkeypatch.setattr(quality_bt, "MOST", {0: 3, 1: 3})
    model = quality_bt.fit(docs, labels, F.lit(True))
    sampled = {r.doc_id for r in quality_bt.sample(docs, labels, "quality", F.lit(True), quality_bt.MOST).collect()}
    strength = {i: float(np.clip((np.array(quality_bt.features(t.encode())) - model.mean) / model.scale, -8, 8) @ model.weights) for i, t, _ in texts_ if i in sampled}
    weight = {i: (0.25 if i % 4 == 0 else 0.75) / 3 for i in sampled}
    ordered = sorted(sampled, key=strength.get)
    below = [sum(weight[j] for j in ordered[: k + 1]) for k in range(6)]
    at = next(k for k, b in enumerate(below) if b >= 0.25 - 1e-9)
    assert len(sampled) == 6 and model.cut == pytest.approx(np.mean([strength[i] for i in ordered[max(0, at - 1) : at + 1]]))


def fitted_plainly(spark, texts_):
    """A model fitted on (doc_id, text, label), and by plain arrays: the mean, the loss's gradient at its weights, and its cut."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts_], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts_], "doc_id long, quality int")
    model = quality_bt.fit(docs, labels, F.lit(True))
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").select("doc_id").collect()]
    of = {i: (quality_bt.features(t.encode()), y) for i, t, y in texts_}
    x, y = np.array([of[i][0] for i in order]), np.array([of[i][1] for i in order])
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    good, bad = z[y == 1], z[y == 0]
    k = np.arange(quality_bt.PAIRS_PER_ROW * max(len(good), len(bad)))
    d = good[k % len(good)] - bad[(k + k // len(good) * 7 + k // len(bad)) % len(bad)]
    gradient = (d / (1 + np.exp(d @ model.weights))[:, None]).sum(0) - quality_bt.L2 * model.weights
    s = np.sort(z @ model.weights)
    return model, x.mean(0), gradient, s[max(0, len(bad) - 2) : len(bad)].mean()


def test_bradley_terry_learns_from_every_labelled_row(spark):
    """Also from more than 5 000 and 10 000 rows of a kind, where a sample was taken once; by brute force."""
    rng = random.Random(11)
    texts_ = [(i, " ".join(words(rng, 3 + i % 17)) + (" ##" if i % 3 == 0 and i % 5 else "."), int(i % 3 > 0)) for i in range(15_900)]
    model, mean, gradient, cut = fitted_plainly(spark, texts_)
    assert model.mean == pytest.approx(mean) and np.abs(gradient).max() < 1e-3 and model.cut == pytest.approx(cut)


@pytest.mark.parametrize("rare", [0, 1])
def test_bradley_terry_with_one_row_of_a_label(spark, rare):
    """The one row is in all pairs and is copied for them; most texts are equal, so are their strengths."""
    texts_ = [(i, "one two three four" if i % 3 else f"w{i} ## {i}", rare if i == 7 else 1 - rare) for i in range(150)]
    model, mean, gradient, cut = fitted_plainly(spark, texts_)
    assert model.mean == pytest.approx(mean) and np.abs(gradient).max() < 1e-3 and model.cut == pytest.approx(cut)


def test_bradley_terry_repeats_and_contradictions(spark):
    """A repeated row counts twice, a label given twice once; a row labelled both ways or without an id is not learned from."""
    docs = spark.createDataFrame([(1, "a b c."), (1, "a b c."), (2, "##"), (3, "x " * 30), (None, "y"), (4, "free")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (9, 0), (4, None)], "doc_id long, quality int")
    x = np.array([quality_bt.features(t) for t in (b"a b c.", b"a b c.", b"##")])
    assert quality_bt.fit(docs, labels, F.lit(True)).mean == pytest.approx(x.mean(0))
    assert quality_bt.fit(docs, labels.where("quality = 1"), F.lit(True)) is None and quality_bt.fit(docs, labels.where("doc_id = 9"), F.lit(True)) is None


def test_cut_is_the_plain_quantile(spark, monkeypatch):
    monkeypatch.setattr(quality_bt, "SLOTS", 3)
    rng = np.random.default_rng(4)
    for values, share in ((rng.normal(size=40), 0.3), (rng.integers(0, 4, 40) / 7, 0.55), (np.zeros(5), 0.4), (np.array([-1e300, 0.0, 5e-324, 1e300]), 0.5)):
        y = np.arange(len(values)) % 3 > 0
        bad, good = share / (~y).sum(), (1 - share) / y.sum()
        order = np.lexsort((y, values))
        table = spark.createDataFrame([(float(s), int((~y & (values == s)).sum()), int((y & (values == s)).sum())) for s in set(values.tolist())], "s double, n_bad long, n_good long")
        assert quality_bt.cut_of(table, bad, good, share) == quality_bt.quantile(values[order], np.where(y, good, bad)[order], share)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(9)
    lengths = [1, 2, 5]
    unary, mask = np.zeros((3, 5, 2)), np.zeros((3, 5), dtype=bool)
    for i, n in enumerate(lengths):
        unary[i, :n], mask[i, :n] = rng.normal(size=(n, 2)), True
    move = rng.normal(size=(2, 2))
    state, pairs = line_crf._posteriors(unary, move, mask)
    expected, moves = np.zeros_like(state), np.zeros((2, 2))
    for i, n in enumerate(lengths):
        paths = list(itertools.product((0, 1), repeat=n))
        score = np.array([np.exp(sum(unary[i, k, s] for k, s in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        for p, w in zip(paths, score / score.sum(), strict=True):
            for k, s in enumerate(p):
                expected[i, k, s] += w
            for a, b in itertools.pairwise(p):
                moves[a, b] += w
    assert np.abs(state - expected).max() < 1e-12 and np.abs(pairs - moves).max() < 1e-12


#: Addresses of the same kinds that no row of the table is made of.
UNSEEN_KEEP = "www.beekeepers-county.org/guides/winter-feeding.html school.oakhill.edu/library/reading-list archives.cathedral-town.fr/registres/1788 docs.smallparser.dev/reference/tokens www.volkshochschule-nord.de/kurse/keramik forum.woodturners.net/threads/first-bowl.92/ news.valleygazette.com/local/school-fair recipes.sundaytable.org/pies/apple".split()
UNSEEN_LEAVE = "cheap-viagra-pills.biz/order/now free-casino-slots.top/bonus/spin hot-adult-cams.xxx/live/12 instant-payday-loan.click/apply/no-credit replica-bags-cheap.shop/outlet/sale crack-keygen-download.cc/full win-free-prize.info/claim/now seo-links-farm.xyz/submit/links".split()


def test_url_filter_on_unseen_addresses(spark):
    assert not {u.split("/")[0] for u in UNSEEN_KEEP + UNSEEN_LEAVE} & {u.split("/")[0] for u in url_filter.KEEP + url_filter.LEAVE}
    pages = spark.createDataFrame([(i, f"https://{u}") for i, u in enumerate(UNSEEN_KEEP + UNSEEN_LEAVE)], "page_id long, url string")
    judged = url_filter.judge(pages, url_filter.fit(url_filter.labelled(spark)), ()).collect()
    right = sum((r.verdict == "block") == (r.page_id >= len(UNSEEN_KEEP)) for r in judged)
    assert right >= 15, [(r.host, r.p_block) for r in judged]


def test_pieces_without_a_document_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    packed = packing.pack_documents(rows, (16, 64)).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in packed)
    assert len(packed) == 600 and len(groups) > 8 and max(groups.values()) < 120
    again = packing.pack_documents(rows.withColumn("doc_id", F.lit(7).cast("long")), (16, 64)).collect()
    assert len({r.bin_id.split("-")[0] for r in again}) > 8
