"""Words of a UTF-8 text as numpy arrays, and hashes of words and of runs of words.

A word's bytes are taken eight at a time, each lane going through a keyed bijection that spreads all
bits, so no sum over a word's bytes decides its hash. Runs are polynomials of word hashes modulo the
prime 2^61 - 1, from prefix sums: two different runs of n words agree for at most n of the 2^61 bases
there are, whatever the words; modulo 2^64, texts made of two words in a regular pattern collide.

These hashes find candidates. What is taken out as equal is compared by its words or by a digest of
them (`digest`).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

U = np.uint64
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = U(PRIME), U((1 << 31) - 1), U((1 << 30) - 1)
#: Bases of the polynomials, by purpose: arbitrary numbers below the prime.
_BASE = {"word": 0x15EED1CE4E5B97F3, "check": 0x0B492B66FBE98F27}
_WORD_KEY, _LANE_KEY = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed by a digest.
LANES = 8
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def byte_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`; every byte of a multi-byte character is a word byte.
SPACED = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A-Z to a-z, all else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def digest(raw: bytes, size: int = 16) -> bytes:
    """A cryptographic digest: texts with equal digests are equal."""
    return blake2b(raw, digest_size=size).digest()


def spans(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends) of a text."""
    a = np.frombuffer(raw, dtype=np.uint8)
    edge = np.zeros(len(a) + 2, dtype=np.int8)
    edge[1:-1] = table[a]
    step = np.diff(edge)
    return a, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.empty(0, dtype=U)
    padded = np.zeros(len(a) + 8, dtype=np.uint8)
    padded[: len(a)] = a
    lanes = np.ndarray(len(a) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    h = mix(mix(size.astype(U) ^ _WORD_KEY) ^ (lanes[starts] & _MASKS[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for lane in range(1, LANES):
        if not len(more):
            break
        left = size[more] - 8 * lane
        h[more] = mix((h[more] + _LANE_KEY) ^ (lanes[starts[more] + 8 * lane] & _MASKS[np.minimum(left, 8)]))
        more = more[left > 8]
    for i in more.tolist():
        h[i] = int.from_bytes(digest(a[starts[i] : ends[i]].tobytes(), 8), "little")
    return h


# --- arithmetic modulo 2^61 - 1 -------------------------------------------------------------------


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of values below the prime, modulo the prime, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + a0 * b0)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse."""
    have = _powers.get(kind)
    if have is None or len(have[0]) < n:
        pair = []
        for base in (_BASE[kind], pow(_BASE[kind], -1, PRIME)):
            p = np.ones(1, dtype=U)
            while len(p) < max(n, 1 << 14):
                p = np.concatenate((p, _times(p, U(pow(base, len(p), PRIME)))))
            pair.append(p)
        have = _powers[kind] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


class Runs:
    """Hashes of any runs of a sequence of word hashes."""

    def __init__(self, words: np.ndarray, kind: str = "word") -> None:
        up, self.down = _power(kind, len(words) + 1)
        terms = _times(_reduced(words), up[:-1])
        low, high = np.cumsum(terms & _LOW31, dtype=U), np.cumsum(terms >> U(31), dtype=U)
        self.total = np.zeros(len(words) + 1, dtype=U)
        self.total[1:] = _reduced(_times(_reduced(high), U(1 << 31)) + _reduced(low))

    @staticmethod
    def _ended(value: np.ndarray, size) -> np.ndarray:
        return mix(value ^ mix(np.atleast_1d(size).astype(U)))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to before end."""
        return self._ended(_times(_less(self.total[end], self.total[start]), self.down[start]), end - start)

    def without(self, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start to before end without the one at `at`, as between() has it of the shorter run."""
        left = _times(_less(self.total[at], self.total[start]), self.down[start])
        right = _times(_less(self.total[end], self.total[at + 1]), self.down[start + 1])  # one place nearer
        return self._ended(_reduced(left + right), end - start - 1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words; none if there are fewer."""
    n = len(words) - k + 1
    if n <= 0 or k <= 0:
        return np.empty(0, dtype=U)
    at = np.arange(n)
    return Runs(words).between(at, at + k)


#: Texts are hashed together up to so many bytes; a longer one by itself.
TOGETHER = 1 << 18


def together(raws: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    start, size = 0, 0
    for i, raw in enumerate(raws):
        n = len(raw or b"") + 1
        if i > start and size + n > TOGETHER:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(raws):
        yield start, len(raws)


class Joined:
    """The words of several texts, hashed together: starts and ends of words, the first word of each text, the text of each word, runs."""

    def __init__(self, raws: list[bytes | None], lower: bool = False) -> None:
        texts = [raw or b"" for raw in raws]
        self.raw = b"\n".join(texts)
        if lower:
            self.raw = self.raw.translate(LOWER)
        a, self.starts, self.ends = spans(self.raw, SPACED)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, begins)
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.runs = Runs(word_hashes(a, self.starts, self.ends))

    def windows(self, k: int) -> np.ndarray:
        """Where windows of k words of one text start."""
        at = np.arange(max(0, len(self.starts) - k + 1))
        return at[self.of[at] == self.of[at + k - 1]]


def distinct(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each of n owners' values begin, its sorted distinct values, one owner's after the other's)."""
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    return np.cumsum(np.append(0, np.bincount(of[new], minlength=n))), values[new]


def shingles(raws: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's shingles begin, sorted distinct hashes of its k-word shingles), A-Z lower-cased; a shorter text's whole sequence is one."""
    joined = Joined(raws, lower=True)
    at = joined.windows(k)
    n = np.diff(joined.first)
    short = np.flatnonzero((n > 0) & (n < k))
    hashes = np.concatenate((joined.runs.between(at, at + k), joined.runs.between(joined.first[short], joined.first[short] + n[short])))
    return distinct(np.concatenate((joined.of[at], short)), hashes, len(raws))
