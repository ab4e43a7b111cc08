"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once with numpy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier of full period and its inverse modulo 2**64.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = np.full(max(n, 1 << 16), _P if kind == "up" else _P_INV, np.uint64)
        step[0] = 1
        _powers[kind] = np.multiply.accumulate(step)
    return _powers[kind]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each maximal run of marked bytes: where it starts, and a hash of its bytes and length.

    The runs' polynomials come from one prefix sum, so the cost does not depend on how the bytes fall into runs.
    """
    starts, ends, sums = _runs(data, is_word)
    raw = (sums[ends] - sums[starts]) * _power("down", len(data))[starts]
    return starts, mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Of each byte, one more.
_MORE = np.arange(1, 257, dtype=np.uint64)


def _runs(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the marked runs, and the prefix sums of the bytes' polynomial."""
    marks = np.zeros(len(data) + 2, bool)
    marks[1:-1] = is_word
    turns = np.flatnonzero(marks[1:] != marks[:-1])
    sums = np.zeros(len(data) + 1, np.uint64)
    own = sums[1:]
    np.take(_MORE, data, out=own, mode="clip")
    own *= _power("up", len(data))[: len(data)]
    np.cumsum(own, out=own)
    return turns[::2], turns[1::2], sums


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, in order."""
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + len(out)])
    return out


#: Bytes that are blank: space, \t, \n, \v, \f, \r.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
#: Tables for bytes.translate: A-Z made small; 1 for bytes that are not blank; 1 for letters, digits and all beyond ASCII.
SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NOT_BLANK = bytes(int(b not in BLANKS) for b in range(256))
ALPHANUMERIC = bytes(int(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256))


def small_bytes(text: str, kind: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text, A-Z made small, and which of them are of a kind (a table of 0 and 1)."""
    raw = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(raw.translate(SMALL), np.uint8), np.frombuffer(raw.translate(kind), bool)


def text_words(text: str) -> np.ndarray:
    """Hashes of the words of a text: runs without blanks, A-Z made small."""
    return word_hashes(*small_bytes(text, NOT_BLANK))[1]


def text_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of k words, sorted; with fewer words the whole sequence is one; without words there is none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(words, min(k, len(words))))


def prefix_hashes(data: np.ndarray, is_word: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of all runs of marked bytes, and of the first ``sizes`` bytes of those that are longer."""
    starts, ends, sums = _runs(data, is_word)
    down, parts = _power("down", len(data)), []
    for n in (0, *sizes):
        s = starts if n == 0 else starts[ends - starts > n]
        e = ends if n == 0 else s + n
        parts.append(mix64((sums[e] - sums[s]) * down[s] + np.uint64(n * 0x9E3779B9 + 1)))
    return np.concatenate(parts)
