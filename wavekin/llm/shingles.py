"""Hashed word shingles of whole texts, vectorised over batches of documents in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

K = 5
#: Bytes hashed at a time; longer texts are cut between words, which changes no hash.
PIECE = 1 << 19

_U = np.uint64
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser in the manner of splitmix, element by element."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=_U), 1)
_PLACE = mix(np.arange(64, dtype=_U), 2) | _U(1)


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    if base not in cache or len(cache[base]) < n:
        steps = np.full(max(n, PIECE + 1), base, dtype=_U)
        steps[0] = 1
        cache[base] = np.multiply.accumulate(steps)
    return cache[base]


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a piece that ends with a blank."""
    blank = data == 32
    edge = np.diff(blank.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    value = _BYTE[data] * _powers(_BASE, len(data))[: len(data)]
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])
    return start, mix((total[end] - total[start]) * _powers(_INVERSE, len(data))[start])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text). A-Z count as a-z; words are split at U+0020 and U+0009-U+000D."""
    parts = [(t or "").encode("utf-8", "surrogatepass") + b" " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    blob = b"".join(parts).translate(_FOLD)
    starts, hashes, at = [], [], 0
    while at < len(blob):
        stop = min(len(blob), at + PIECE)
        if stop < len(blob):
            cut = blob.rfind(b" ", at, stop)
            stop = (cut if cut >= 0 else blob.index(b" ", stop)) + 1
        s, h = _hash_piece(np.frombuffer(blob, np.uint8, stop - at, at))
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    where = np.searchsorted(ends, np.concatenate(starts), side="right")
    return np.concatenate(hashes), np.bincount(where, minlength=len(texts))


def shingle_sets(texts: list[str | None], k: int = K) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; fewer words make one shingle of them all."""
    words, counts = word_hashes(texts)
    n = len(words)
    runs = np.zeros(max(0, n - k + 1), _U)
    for j in range(k):
        runs += words[j : n - k + 1 + j] * _PLACE[j] if n >= k else _U(0)
    runs = mix(runs, 3)
    at = 0
    for c in counts:
        if c >= k:
            yield np.unique(runs[at : at + c - k + 1])
        elif c:
            yield mix(np.sum(words[at : at + c] * _PLACE[:c], keepdims=True, dtype=_U), 100 + int(c))
        else:
            yield np.zeros(0, _U)
        at += c
