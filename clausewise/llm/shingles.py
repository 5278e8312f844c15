"""Hashed word shingles of many texts at once.

Words are runs of characters other than the white space of ``common.WHITE``, A-Z
lower-cased. All arithmetic is on 64-bit integers over the bytes of a whole batch.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13, 0xFF])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; another one for each salt."""
    x = x ^ np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2 ** 64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, 2^bits of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2 ** 64)):
        steps = np.full(1 << bits, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes; span_hash() takes a span's hash from them."""
    power = _powers(max(21, len(b).bit_length()))[0]
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:len(b)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _powers(max(21, (len(sums) - 1).bit_length()))[1]
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (0xFF behind each), word begins and ends, words per text."""
    b = np.frombuffer(b"\xff".join([t.encode("utf-8", "replace") for t in texts] + [b""]).lower(), np.uint8)
    turn = np.flatnonzero(np.diff(_SPACE[b], prepend=True, append=True))
    begin, end = turn[::2], turn[1::2]
    n_words = np.diff(np.searchsorted(begin, np.flatnonzero(b == 0xFF)), prepend=0)
    return b, begin, end, n_words


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-word shingles in order, shingles per text, words per text.

    A text with fewer than k words but at least one has its whole sequence as one shingle.
    """
    b, begin, end, n_words = word_spans(texts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), int), n_words
    word = span_hash(prefix_sums(b), begin, end)
    pad = np.concatenate([word, np.zeros(k, np.uint64)])
    whole = np.zeros(len(word), np.uint64)
    for i in range(k):
        whole = mix(whole + pad[i:i + len(word)], i + 1)
    first = np.cumsum(n_words) - n_words
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    out = whole[at]
    short = np.flatnonzero((n_words < k) & (n_words > 0))
    at_out = (np.cumsum(n) - n)[short]
    for i, o in zip(short, at_out):
        h = np.zeros(1, np.uint64)
        for w in range(first[i], first[i] + n_words[i]):
            h = mix(h + word[w:w + 1], int(n_words[i]) + 100)
        out[o] = h[0]
    return out, n, n_words


def portions(texts: list[str], chars: int):
    """Ranges of rows with about so many characters each, a longer text for itself."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
