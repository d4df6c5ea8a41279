"""Words and word shingles of a batch of texts, hashed by array operations."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def mix64(z: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return z ^ (z >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's first word (n + 1 entries).

    A word is a maximal run of bytes other than ASCII white space in the lower-cased text.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(data)), out=run[1:])
    h = mix64((run[stop] - run[start]) * _powers(_INV, len(data))[start] + (stop - start).astype(np.uint64))
    return h, np.concatenate([[0], np.searchsorted(start, ends_of)])


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions reach past the end and wrap to nothing."""
    out = np.zeros(len(h), np.uint64)
    for i in range(k):
        part = h[i:]
        out[: len(part)] = out[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part
    return mix64(out)
