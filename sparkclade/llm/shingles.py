"""Word-shingle hashing of whole texts with numpy.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` after A-Z have been
lower-cased.  A word's 64-bit hash is a tabulated polynomial over its bytes,
taken from one cumulative sum for all words of a segment; a shingle's hash mixes
five word hashes.  Texts are processed in segments cut at white space, so memory
is bounded by the segment length plus eight bytes for each word of one text.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
SEGMENT = 1 << 20

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTE[_SPACE] = 0
_PLACE = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_STATE.get("pow", ())) < n:
        n = 1 << max(n, SEGMENT + 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("pow", _BASE), ("inv", inverse)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _STATE[key] = np.multiply.accumulate(table)
    return _STATE["pow"], _STATE["inv"]


def _segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a piece of text that is already lower-cased."""
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    powers, inverse = _powers(len(b))
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    if not space[-1]:
        edge = np.concatenate((edge, [len(b)]))
    start, end = edge[0::2], edge[1::2]
    total = np.cumsum(_BYTE[b] * powers[: len(b)], dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], _U(0))
    return start, mix((total[end - 1] - before) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and where each text's words begin (one more entry)."""
    joined = b"\n".join(texts).translate(_LOWER)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    begin[1:] = np.cumsum([len(t) + 1 for t in texts])
    starts, hashes, at = [], [], 0
    while at < len(joined):
        to = min(at + SEGMENT, len(joined))
        while to < len(joined) and not _SPACE[joined[to]]:
            to += 1
        s, h = _segment(joined[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    if not starts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of one to four words is one shingle."""
    words, at = word_hashes(texts)
    empty = np.zeros(0, dtype=np.uint64)
    if not len(words):
        return [empty] * len(texts)
    total = words * _PLACE[0]
    for k in range(1, min(SHINGLE, len(words))):
        total[: len(words) - k] += words[k:] * _PLACE[k]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.array([b - a], dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F)
            out.append(mix(short))
        else:
            out.append(empty)
    return out
