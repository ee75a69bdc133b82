"""Hashes of word shingles, computed for many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.default_rng(10).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the text it belongs to; A-Z count as a-z."""
    parts = [t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) + 1
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - start
    power = np.cumprod(np.full(int(size.max()), _BASE), dtype=np.uint64)
    letters = data[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    hashes = np.add.reduceat(_RANDOM[letters] * power[place], first)
    return mix(hashes), np.searchsorted(ends, start, side="right")


def sets(texts: list[str], k: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle."""
    word, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    whole = max(len(word) - k + 1, 0)
    rolled = np.full(whole, np.uint64(k))
    for j in range(k):
        rolled = (rolled ^ word[j:j + whole]) * _BASE + np.uint64(j)
        rolled ^= rolled >> np.uint64(29)
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            h = np.sort(rolled[a:b - k + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = mix(np.array([h ^ w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def chunks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``chars`` characters."""
    low, held = 0, 0
    for i, t in enumerate(texts):
        if i > low and held + len(t) > chars:
            yield low, i
            low, held = i, 0
        held += len(t)
    if texts:
        yield low, len(texts)


def chunk_name(content: bytes, partition: int, number: int) -> bytes:
    """Digest of a chunk's content and place: equal chunks of repeated rows stay apart."""
    place = np.array([partition, number], "<i8").tobytes()
    return hashlib.blake2b(place + content, digest_size=16).digest()
