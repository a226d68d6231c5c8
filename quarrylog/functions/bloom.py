"""Bloom filters over terms: sized for a false-positive rate, double hashing, little-endian bytes."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa

from ..schema import BLOOM_P

_U = (1 << 64) - 1


def parameters(n: int, p: float = BLOOM_P) -> tuple[int, int]:
    """Bits and probes for n terms at rate p."""
    n = max(n, 1)
    p = p if 0 < p < 1 else 0.01
    bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, min(max(math.floor(bits / n * math.log(2) + 0.5), 1), 64)


def _spread(z: int) -> int:
    z = (z + 0x9E3779B97F4A7C15) & _U
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _U
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _U
    return z ^ (z >> 31)


def hashes(term: str) -> tuple[int, int]:
    """FNV-1a over the UTF-8 bytes, and a spread of it made odd."""
    h = 14695981039346656037
    for b in term.encode():
        h = ((h ^ b) * 1099511628211) & _U
    return h, _spread(h) | 1


def _fnv(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of many terms at once: a step of numpy for each byte position, over the terms that reach it."""
    order = np.argsort(-size, kind="stable")  # those that reach a position come first
    at, size = at[order], size[order]
    h = np.full(len(at), 14695981039346656037, np.uint64)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        h[:n] = (h[:n] ^ buf[at[:n] + k]) * np.uint64(1099511628211)
    a = np.empty_like(h)
    a[order] = h
    return a


def _spreads(a: np.ndarray) -> np.ndarray:
    z = a + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def hash_pairs(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """hashes() of all terms at once."""
    raw = [t.encode() for t in terms]
    size = np.array([len(r) for r in raw], np.int64)
    a = _fnv(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size)
    return a, _spreads(a)


def term_hashes(terms: pa.StringArray) -> np.ndarray:
    """The first of hashes() of each term of an Arrow array without nulls; the second follows from it."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    kind = np.int64 if pa.types.is_large_string(terms.type) else np.int32
    ends = np.frombuffer(terms.buffers()[1], kind)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    return _fnv(np.frombuffer(terms.buffers()[2] or b"", np.uint8), ends[:-1], np.diff(ends))


def build(terms, p: float = BLOOM_P) -> bytes:
    """k as u32, m as u64, then the bits."""
    return build_hashed(hash_pairs(list(dict.fromkeys(terms)))[0], p)


def build_hashed(a: np.ndarray, p: float = BLOOM_P) -> bytes:
    """build() from the distinct first hashes of the terms."""
    m, k = parameters(len(a), p)
    bits, b = np.zeros(m, bool), _spreads(a)
    for i in range(k):
        bits[(a + np.uint64(i) * b) % np.uint64(m)] = True
    return struct.pack("<IQ", k, m) + np.packbits(bits, bitorder="little").tobytes()


def read(data: bytes | None) -> tuple[int, int, bytes] | None:
    """k, m and the bits; None if the bytes can't be a filter."""
    if not data or len(data) < 12:
        return None
    k, m = struct.unpack_from("<IQ", data)
    if not 1 <= k <= 64 or m < 1 or len(data) - 12 != (m + 7) // 8:
        return None
    return k, m, data[12:]


def may_contain(data: bytes | None, term: str) -> bool:
    """False only if the term is certainly absent; a missing or damaged filter excludes nothing."""
    f = read(data)
    if f is None:
        return True
    k, m, bits = f
    a, b = hashes(term)
    return all(bits[at >> 3] >> (at & 7) & 1 for i in range(k) for at in [((a + i * b) & _U) % m])


def passed(data: bytes | None, terms: list[str]) -> np.ndarray:
    """may_contain() of many terms at once."""
    f = read(data)
    if f is None:
        return np.ones(len(terms), bool)
    k, m, raw = f
    (a, b), bits, out = hash_pairs(terms), np.frombuffer(raw, np.uint8), np.ones(len(terms), bool)
    for i in range(k):
        at = (a + np.uint64(i) * b) % np.uint64(m)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def may_contain_all(data: bytes | None, terms) -> bool:
    return all(may_contain(data, t) for t in terms)
