"""Operator 3: quality rules, with a linear-chain conditional random field over lines.

Base rules count words, symbols, repeated lines and repeated three-word windows of a whole text. Then
each line is content or boilerplate: a two-state conditional random field over line features is
decoded by Viterbi, and a document is kept if content lines hold CONTENT_SHARE of its words.

There are no labelled lines, so the field is fitted to seed labels of a bounded sample of documents
(SAMPLE distinct texts, SAMPLE_LINES adjacent lines of each, from a place that the text's hash picks):
lines on which several seed rules agree. Lines
without a seed label are latent: the fit maximises the likelihood of the labelled ones and sums over
the others. Every document is decoded over all its lines.

Edge cases: null and empty texts have no words and fail the base rules; lines without a word are
skipped; an empty table gives no rows and fits nothing; other columns pass through `judge`
untouched, an older column named rules is replaced; repeated rows are each judged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaster.llm.shared import map_texts
from cadaster.llm.text import SPACED, digest as digest_of, spans, window_hashes, word_hashes

SAMPLE, SAMPLE_LINES = 1_500, 64
CONTENT_SHARE = 0.5
STEPS, RATE, L2 = 120, 0.5, 0.01
MIN_WORDS, REPEAT_SHARE = 50, 0.5

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
#: What a code point's further bytes are; they are not counted.
FURTHER = bytes(range(0x80, 0xC0))
#: Phrases of notices, in lower case: fixed values.
NOTICE = re.compile(rb"copyright|all rights reserved|licensed under|general public license|creative commons|cookie|subscribe|sign up|privacy policy|terms of (?:use|service)|click here|log ?in\b|share this|powered by")
CONTENT, BOILERPLATE = 0, 1


def base(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    raw = raw or b""
    hashes = word_hashes(*spans(raw, SPACED))
    windows = window_hashes(hashes, 3)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    found = np.flatnonzero(times[which] > 1) if len(windows) else np.empty(0, dtype=np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + 3, -1)
    lines = [x for x in raw.split(b"\n") if x.strip(SEPARATORS)]
    return (
        len(hashes),
        len(raw.translate(None, SEPARATORS + FURTHER)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        int((np.cumsum(cover[:-1]) > 0).sum()),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or n_repeat_words > REPEAT_SHARE * n_words


N_FEATURES = 12


def line_features(raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line that has a word, words of each)."""
    lines = [x for x in (raw or b"").split(b"\n") if x.strip(SEPARATORS)]
    out, words, before = np.zeros((len(lines), N_FEATURES), dtype=np.float64), np.zeros(len(lines), dtype=np.int64), set()
    for i, line in enumerate(lines):
        w = line.split()
        n, size = len(w), len(line)
        words[i] = n
        upper = size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = size - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        symbols = size - len(line.translate(None, SYMBOLS))
        digits = size - len(line.translate(None, b"0123456789"))
        out[i] = (
            1.0,
            min(np.log1p(n) / 4, 1.5),
            float(n <= 3),
            float(line.rstrip()[-1:] in (b".", b"?", b":", b'"')),
            min(1.0, 3 * symbols / n),
            min(1.0, 2 * upper / max(1, upper + lower)),
            min(1.0, 2 * line.count(b"|") / n),
            min(1.0, 2 * sum(map(bytes.__eq__, w[1:], w[:-1])) / n),
            float(line in before),
            min(1.0, 4 * digits / size),
            float(NOTICE.search(line.lower()) is not None),
            min(1.0, 2 * line.count(b"!") / n),
        )
        before.add(line)
    return out, words


def seeds(x: np.ndarray) -> np.ndarray:
    """Seed labels of lines: -1 where the seed rules do not agree."""
    odd = (x[:, 4] > 0.6) * 1 + (x[:, 5] > 0.9) + (x[:, 6] > 0.6) + (x[:, 7] > 0.5) + (x[:, 8] > 0) + 2 * (x[:, 10] > 0) + (x[:, 11] > 0.6) + (x[:, 9] > 0.8)
    prose = (x[:, 1] > 0.55) & (odd == 0)
    return np.where(prose, CONTENT, np.where(odd > 0, BOILERPLATE, -1))


@dataclass(frozen=True)
class Field:
    emit: np.ndarray  # features x 2
    move: np.ndarray  # 2 x 2, from and to

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states of a document's lines; of equals, content."""
        unary = (x @ self.emit).tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        c, b, back = 0.0, 0.0, []
        for i, (uc, ub) in enumerate(unary):
            if i:
                from_c, to_b = c + cc >= b + bc, b + bb > c + cb
                back.append((from_c, to_b))
                c, b = (c + cc if from_c else b + bc) + uc, (b + bb if to_b else c + cb) + ub
            else:
                c, b = uc, ub
        state, states = (BOILERPLATE if b > c else CONTENT), []
        for from_c, to_b in reversed(back):
            states.append(state)
            state = (CONTENT if from_c else BOILERPLATE) if state == CONTENT else (BOILERPLATE if to_b else CONTENT)
        return np.array([state, *reversed(states)] if unary else [], dtype=np.int64)


def _posteriors(unary: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, and move expectations) of padded sequences, by the forward-backward sums."""
    n, t, _ = unary.shape
    add = np.logaddexp
    f, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    f[:, 0] = unary[:, 0]
    for i in range(1, t):
        f[:, i] = np.where(mask[:, i, None], add(f[:, i - 1, 0, None] + move[0], f[:, i - 1, 1, None] + move[1]) + unary[:, i], f[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = unary[:, i + 1] + b[:, i + 1]
        b[:, i] = np.where(mask[:, i + 1, None], add(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None]), b[:, i + 1])
    z = add(f[:, -1, 0], f[:, -1, 1])
    state = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
    pair = np.exp(f[:, :-1, :, None] + move + (unary[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return state, pair.sum((0, 1))


def fit_field(documents: list[np.ndarray]) -> Field:
    """Gradient ascent on the likelihood of the seed labels, lines without one being latent."""
    documents = [d for d in documents if len(d)]
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not documents:
        return Field(emit, move)
    n, t = len(documents), max(map(len, documents))
    x, mask, free = np.zeros((n, t, N_FEATURES)), np.zeros((n, t), dtype=bool), np.zeros((n, t, 2))
    for i, d in enumerate(documents):
        x[i, : len(d)], mask[i, : len(d)] = d, True
        y = seeds(d)
        free[i, : len(d), CONTENT][y == BOILERPLATE] = -1e4
        free[i, : len(d), BOILERPLATE][y == CONTENT] = -1e4
    total, squares = mask.sum(), [np.full_like(emit, 1e-8), np.full_like(move, 1e-8)]
    for _ in range(STEPS):
        unary = x @ emit
        seen, seen_moves = _posteriors(unary + free, move, mask)
        any_, any_moves = _posteriors(unary, move, mask)
        gradients = np.einsum("ntf,nts->fs", x, seen - any_) / total - L2 * emit, (seen_moves - any_moves) / total - L2 * move
        for p, g, s in zip((emit, move), gradients, squares, strict=True):  # per-coordinate rates
            s += g * g
            p += RATE * g / np.sqrt(s)
    return Field(emit, move)


def some_lines(x: np.ndarray, raw: bytes) -> np.ndarray:
    """SAMPLE_LINES adjacent lines of a text, from a place that its hash picks; all of a shorter one."""
    start = int.from_bytes(digest_of(raw, 8), "little") % max(1, len(x) - SAMPLE_LINES + 1)
    return x[start : start + SAMPLE_LINES]


def fit(docs: DataFrame) -> Field:
    """The field, from a bounded sample of distinct texts: those of smallest hash, whatever their number of copies."""
    texts = docs.where("text is not null and doc_id is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    taken = texts.orderBy("h").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").where(F.xxhash64("text") == F.col("h"))

    def per_text():
        return lambda raw: ([line.tolist() for line in some_lines(line_features(raw)[0], raw)],)

    found = map_texts(rows, ["h", "doc_id"], "x array<array<double>>", per_text).orderBy("h", "doc_id").collect()
    return fit_field([np.array(r.x) for r in {r.h: r for r in found}.values()])


def judge(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) with `rules`: the base counts, base_failed, content_lines, content_share and kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "rules"]

    def per_text():
        def one(raw):
            n, chars, symbols, dup, repeat = base(raw)
            failed = base_failed(n, repeat)
            x, words = line_features(raw)
            content = field.viterbi(x) == CONTENT
            share = float(words[content].sum() / max(1, words.sum()))
            return ({"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "content_lines": np.flatnonzero(content).tolist(), "content_share": share, "kept": not failed and share >= CONTENT_SHARE},)

        return one

    fields = "rules struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,content_lines:array<int>,content_share:double,kept:boolean>"
    return map_texts(docs, keep, fields, per_text)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", *(F.col(f"rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")))
