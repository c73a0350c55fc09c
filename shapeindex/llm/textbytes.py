"""Numpy helpers over the UTF-8 bytes of many texts at once: word tables, hashes, sliding minima."""
from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers of the hashes.
MUL = U64(0x9E3779B97F4A7C15)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
POS_BITS = U64((1 << 20) - 1)
LONG = 256  # bytes of a word that are hashed in lanes
#: FIXED: white space between words (space and 9 to 13).
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * MIX1
    x = x ^ (x >> U64(27))
    x = x * MIX2
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * MUL)


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts joined by a space, start and end of each word in them, and the index of its text."""
    buf = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = np.empty(len(buf) + 1, dtype=np.int8)
    inside[0] = 0
    inside[1:] = ~SEPARATOR[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else np.zeros(0, dtype=np.int64)
    return buf, starts, ends, np.searchsorted(first, starts, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word; other seeds give independent hashes.

    Eight bytes at a time go through ``mix``, which is no polynomial: no choice of letters makes words of equal hash as
    sums of products do. Words of more than LONG bytes are hashed one by one (xxh3).
    """
    n = ends - starts
    out = mix(n.astype(U64) * MIX1 ^ U64((seed * int(MUL)) & 0xFFFFFFFFFFFFFFFF))
    if not len(starts):
        return out
    lanes = np.ndarray(len(buf), dtype="<u8", buffer=np.append(buf, np.zeros(8, dtype=np.uint8)), strides=(1,))
    own = np.flatnonzero(n <= LONG)
    at = 0
    while len(own):
        left = n[own] - at
        word = lanes[starts[own] + at]
        short = left < 8
        word[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[own] = mix((out[own] ^ word) * MUL)
        own, at = own[left > 8], at + 8
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed=seed)
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= MUL
        acc += h[j : n + j]
    return mix(acc + U64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    cur, size = x, 1
    while size * 2 <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    if size < w:
        cur = np.minimum(cur[: n], cur[w - size : w - size + n])
    return cur[:n]


def minimizers(g: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w consecutive hashes (by the upper bits; mostly the first of equal ones)."""
    at = np.arange(len(g), dtype=U64)
    m = sliding_min((g & ~POS_BITS) | (at & POS_BITS), w)
    s = np.arange(len(m), dtype=U64)
    return (s + (((m & POS_BITS) - s) & POS_BITS)).astype(np.int64)


def first_of_groups(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: whether a row differs from the one before in any key."""
    out = np.zeros(len(keys[0]), dtype=bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """``values`` at ``wanted`` for sorted ``keys``; ``missing`` where there is no such key."""
    if not len(keys):
        return np.full(len(wanted), missing, dtype=np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], missing)
