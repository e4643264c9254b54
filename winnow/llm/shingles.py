"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .base import in_slices

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Texts to a slice, and about how many bytes of them: a slice's arrays take some 80 bytes for each.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), 0x100000001B3 | 0x5BD1E99500000000, dtype=np.uint64)]))


def word_hashes(texts: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of lower-cased texts, in order, and how many each text has."""
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    space = SPACE[raw]
    before = np.ones(len(raw), dtype=bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    spans = np.diff(starts, append=len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, spans)
    part = raw[starts[0] :].astype(np.uint64) + np.uint64(1)
    part *= powers(int(spans.max()))[place]
    part[space[starts[0] :]] = 0
    return mix(np.add.reduceat(part, starts - starts[0]) ^ np.uint64(seed)), counts


@dataclass
class Sets:
    """Distinct shingles of each text: sorted by text, then by hash."""

    doc: np.ndarray
    hash: np.ndarray
    size: np.ndarray

    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def shingle_sets(texts: list[bytes], words: int, seed: int = 0) -> Sets:
    """The sets of ``words``-word shingles; a text of fewer words has its whole sequence as one."""
    w, counts = word_hashes(texts, seed)
    first = np.cumsum(counts) - counts
    number = np.maximum(counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), number)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    span = np.minimum(counts, words)[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    for i in range(words):
        inside = span > i
        nxt = np.zeros(len(doc), dtype=np.uint64)
        nxt[inside] = w[at[inside] + i]
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(1)), h)
    sort_each(h, number)
    if len(h):
        fresh = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        doc, h = doc[fresh], h[fresh]
    return Sets(doc, h, np.bincount(doc, minlength=len(texts)))


def sort_each(values: np.ndarray, lengths: np.ndarray) -> None:
    """Sort consecutive runs of the given lengths, each by itself, in place."""
    a = 0
    for n in lengths.tolist():
        values[a : a + n].sort()
        a += n


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in in_slices(texts, SLICE_BYTES):
        for i in range(a, b, SLICE_ROWS):
            yield i, min(b, i + SLICE_ROWS)


def set_keys(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's set."""
    raw, out, a = sets.hash.astype("<u8").tobytes(), [], 0
    for b in (sets.ends() * 8).tolist():
        out.append(hashlib.blake2b(raw[a:b], digest_size=16).digest())
        a = b
    both = np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def parity_maps(sets: Sets, words: int = 8) -> np.ndarray:
    """For each set, 64 * ``words`` bits: the parity of the hashes that fall on each bit.

    Two sets' maps differ in at most as many bits as the sets have elements not in common.
    """
    bits = 64 * words
    at = sets.doc * bits + (sets.hash % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets.size) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view("<i8").reshape(-1, words)


def long_set(num: int, den: int, words: int = 8) -> int:
    """The size from which the short maps cannot tell sets apart that are not alike: linked sets may
    differ in 2 (den - num) / (num + den) of their size, maps of unlike ones differ in half their bits."""
    return max(64, int(64 * words / map_share(num, den)))


def map_share(num: int, den: int) -> float:
    """Bits of a long parity map for each element of a set."""
    return max(4.8 * (den - num) / (num + den), 1 / 64)


def long_maps(sets: Sets, num: int, den: int, words: int = 8) -> list[bytes | None]:
    """Longer parity maps of the sets above ``long_set``: a power of two of bits, by their size."""
    ends, out = sets.ends(), []
    least, share = long_set(num, den, words), map_share(num, den)
    for i, n in enumerate(sets.size.tolist()):
        if n <= least:
            out.append(None)
            continue
        bits = 1 << max(9, (int(n * share) - 1).bit_length())
        h = (sets.hash[ends[i] - n : ends[i]] % np.uint64(bits)).astype(np.int64)
        out.append(np.packbits((np.bincount(h, minlength=bits) & 1).astype(np.uint8)).tobytes())
    return out


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two parity maps differ, the longer one folded to the other's length."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
