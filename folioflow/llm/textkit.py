"""Vectorised word kernels over Arrow string columns.

Everything here works on whole texts, one slice of documents at a time (``slices`` bounds
the bytes held at once; a text longer than the bound is a slice of its own). Words are found
and hashed with numpy on the UTF-8 buffer; no Python object is made per word.

A span's hash joins two polynomials over its bytes, one modulo 2 ** 64 and one modulo the prime
2 ** 31 - 1: the first alone has equal values for some structured strings (Thue-Morse words).

Null texts count as empty texts throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: some 20 arrays of 8 bytes a text byte are alive in a kernel, so a worker holds about 100 MB
SLICE_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PRIME = np.uint64((1 << 31) - 1)
_FIELD = 1_220_703_125  # a multiplier of this field's congruential generators
_one = np.ones(1, np.uint64)


class Powers(NamedTuple):
    up: np.ndarray
    down: np.ndarray
    up_prime: np.ndarray
    down_prime: np.ndarray


class Prefix(NamedTuple):
    """Running sums of a text's bytes times powers, modulo 2 ** 64 and in the prime field (unreduced)."""

    wide: np.ndarray
    prime: np.ndarray


_powers = Powers(_one, _one, _one, _one)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
NON_ALNUM = np.zeros(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    NON_ALNUM[lo : hi + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_LOWER = _BYTE[LOWER]
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE_LOWER = _CODE[LOWER]


def fold(x: np.ndarray) -> np.ndarray:
    """The same residue modulo 2 ** 31 - 1 in about 32 bits; twice it is in 31 bits and the prime's excess."""
    return (x & _PRIME) + (x >> np.uint64(31))


def _field_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, int(_PRIME)))
        part = out[: min(done, n - done)] * step
        out[done : done + len(part)] = part % _PRIME
        done += len(part)
    return out


def powers(n: int) -> Powers:
    """Powers 0..n of the hash bases and of their inverses; kept up to 4 slices long."""
    global _powers
    if len(_powers.up) > n:
        return _powers
    both = []
    for base in (_BASE, _INVERSE):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    found = Powers(*both, _field_powers(_FIELD, n + 1), _field_powers(pow(_FIELD, -1, int(_PRIME)), n + 1))
    if n <= 4 * SLICE_BYTES:
        _powers = found
    return found


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0, one more than rows) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, and idle ones add up."""
    if _trim:
        _trim(0)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of each hold about ``limit`` bytes at most."""
    for batch in batches:
        at = 0
        texts = batch.column(batch.schema.get_field_index(column))
        _, offsets = buffers(texts)
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    release()


class Words:
    """Words of a slice: ``start``/``end`` byte positions, ``hash``, and ``first`` (the index of
    each document's first word, one more entry than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool):
        n = len(data)
        word = ~separators[LOWER[data] if lower else data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._text = data, lower

    @cached_property
    def prefix(self) -> Prefix:
        return prefix_hash(*self._text)

    @cached_property
    def hash(self) -> np.ndarray:
        return span_hash(self.prefix, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def prefix_hash(data: np.ndarray, lower: bool = False) -> Prefix:
    p = powers(len(data))
    wide, prime = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p.up[: len(data)], out=wide[1:])
    np.cumsum(fold((_CODE_LOWER if lower else _CODE)[data] * p.up_prime[: len(data)]), out=prime[1:])
    return Prefix(wide, prime)


def span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand."""
    p = powers(len(prefix.wide) - 1)
    size = (end - start).astype(np.uint64)
    field = fold(fold(prefix.prime[end] - prefix.prime[start])) * p.down_prime[start]
    wide = (prefix.wide[end] - prefix.wide[start]) * p.down[start] + size
    return mix(wide ^ mix(fold(fold(field)) % _PRIME + (size << np.uint64(32))))


def sequence_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 62 bits of each span of ``values`` (hashes): four polynomials in the prime field."""
    p = powers(len(values))
    size = (end - start).astype(np.uint64)
    parts = []
    for salt in (1, 2, 3, 4):
        code = mix(values + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(33)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(fold(fold(code * p.up_prime[: len(values)])), out=sums[1:])
        parts.append(fold(fold(fold(fold(sums[end] - sums[start])) * p.down_prime[start])) % _PRIME)
    return tuple(mix((a << np.uint64(31) | b) ^ mix(size)) for a, b in (parts[:2], parts[2:]))


def word_hash(words: list[bytes], lower: bool = False) -> np.ndarray:
    """The hash ``Words`` gives each of these words."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), np.uint8)
    return span_hash(prefix_hash(data, lower), ends - lengths, ends)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries; n - 1 fewer than entries, not cut at documents."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    acc = mix(hashes[:m] + np.uint64(n))
    for t in range(1, n):
        acc = mix(acc * _BASE + hashes[t : t + m])
    return acc


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct n-word shingles, sorted; a document of fewer words,
    but not none, has its whole sequence as its only one."""
    doc, counts = words.doc, words.counts
    grams = ngrams(words.hash, n)
    inside = doc[: len(grams)] == doc[n - 1 : n - 1 + len(grams)]
    d, h = doc[: len(grams)][inside], grams[inside]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            at = words.first[short]
            acc = mix(words.hash[at] + np.uint64(k))
            for t in range(1, k):
                acc = mix(acc * _BASE + words.hash[at + t])
            d, h = np.concatenate([d, short]), np.concatenate([h, acc])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        d, h = d[keep], h[keep]
    return d, h


def kernel(texts: pa.Array, separators: np.ndarray, lower: bool) -> Words:
    return Words(*buffers(texts), separators, lower)
