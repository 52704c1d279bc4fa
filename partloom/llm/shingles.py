"""Word shingles of many texts at once, as 64-bit hashes in arrays.

Words are runs of characters other than ASCII white space, lower-cased A to Z; a shingle is `n` consecutive words, and a text
of fewer words, but not none, is one shingle. Equal word sequences have equal hashes. A word is hashed in blocks of eight
bytes, each mixed with a key of its place before they are added, so no arrangement of blocks cancels out; different words, and
different shingles, share a hash with odds of 2^-64 for a pair that isn't made to.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: What the places of blocks are keyed with, and bytes of a block.
KEY, BLOCK = U(0x9E3779B97F4A7C15), 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every range of bytes."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, U)
    n = np.maximum(1, -(-size // BLOCK))
    first = np.cumsum(n) - n
    j = np.arange(int(n.sum())) - np.repeat(first, n)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    window = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    left = np.repeat(size, n) - BLOCK * j
    with np.errstate(over="ignore"):
        block = window[np.minimum(np.repeat(starts, n) + BLOCK * j, len(data))]
        block = np.where(left >= BLOCK, block, block & ((U(1) << (U(8) * np.clip(left, 0, BLOCK - 1).astype(U))) - U(1)))
        mixed = mix(block ^ mix((j.astype(U) + U(1)) * KEY))
        return mix(np.add.reduceat(mixed, first) + size.astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of all texts, begin, end and hash of every word in them, and each text's number of words."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    h = hashed(data, starts, ends)
    return data, starts, ends, h, np.diff(np.searchsorted(starts, begin))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and each text's number of words."""
    *_, h, counts = word_spans(texts)
    return h, counts


def shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, counts = word_hashes(texts)
    first = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        s = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            s = mix(s * U(3) + U(k)) + h[k : len(h) - n + 1 + k]
        s = mix(s)
        out = []
        for i, c in enumerate(counts.tolist()):
            if c >= n:
                out.append(np.unique(s[first[i] : first[i] + c - n + 1]))
            elif c:
                x = U(c)
                for w in h[first[i] : first[i] + c]:
                    x = mix(np.array([x * U(3) + w]))[0]
                out.append(np.array([x], U))
            else:
                out.append(np.zeros(0, U))
    return out


def minhash(sets: list[np.ndarray], k: int, seed: int = 7) -> np.ndarray:
    """k signature coordinates of each set, as 32-bit values; an empty set has all ones."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            x = (s >> U(32)).astype(np.uint32)
            for lo in range(0, len(x), 1024):
                np.minimum(out[i], (x[lo : lo + 1024, None] * a + b).min(0), out=out[i])
    return out
