"""Context-tree weighting over bytes.

A byte is eight binary decisions, the nodes 1..255 of a binary tree; each node has its own tree of
contexts, the last 0..DEPTH bytes. A context's counts (a zeros, b ones) have the
Krichevsky-Trofimov probability Pe, and its weighted probability is

    Pw = Pe                          at full depth,
    Pw = (Pe + prod of children Pw) / 2   above it.

All of this depends on counts only, so it is computed from the table of (DEPTH+1)-grams of the
training text. From the root down, the share of the weight that stops at a context is
q = Pe / (2 Pw), and a node's prediction is the sum over the path of (weight that reaches the
context) * q * (b + 1/2) / (a + b + 1). Contexts without counts predict 1/2, as they should.

Contexts are worked on in groups; those with equal last ``GROUP`` bytes are in one. What lies above
depends on sums by the last GROUP - 1 = 2 bytes, a table of its own; of that, sums by the last byte, at
most 256 contexts of 255 nodes, are put together on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 5
GROUP = 3
ABOVE = (1 << (8 * GROUP)) - 1  # of a key (context << 8 | node), what stands one level above the groups
START = b"\n" * DEPTH
HALF = np.log(0.5)


def normal(text: bytes) -> list[bytes]:
    """Lower-cased words; the modelled sequence is the words joined by spaces and a line feed."""
    return text.lower().split()


def sequence(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


def grams(sequences: list[bytes]) -> np.ndarray:
    """For each byte of the sequences, it and the DEPTH bytes before it as an integer.

    The bytes before a sequence are line feeds, which words never hold.
    """
    raw = np.frombuffer(START + START.join(sequences), dtype=np.uint8)
    ends = np.cumsum([len(s) + DEPTH for s in sequences])
    out = np.zeros(len(raw) - DEPTH, dtype=np.int64)
    for i in range(DEPTH + 1):
        out <<= 8
        out |= raw[i : len(raw) - DEPTH + i]
    keep = np.ones(len(out), dtype=bool)
    for k in range(DEPTH):  # windows that end in the bytes put between sequences
        keep[ends[:-1] - DEPTH + k] = False
    return out[keep]


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma(z) for z > 0: Stirling's series at z + 8, brought back by the recurrence."""
    shift = np.ones_like(z)
    for i in range(8):
        shift = shift * (z + i)
    x = z + 8
    u = 1 / (x * x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - u / 1188) * u) * u) * u) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones, in any order."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """The contexts of one depth for one bit: keys (context << 8 | node) and what holds there."""

    keys: np.ndarray
    parent: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    log_pw: np.ndarray
    stop: np.ndarray


def node_of(byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The node at which the bit is decided (highest bit first) and the bit's value."""
    return (1 << bit) | (byte >> (8 - bit)), (byte >> (7 - bit)) & 1


def leaves(gram: np.ndarray, n: np.ndarray, bit: int) -> tuple[Level, np.ndarray]:
    node, value = node_of(gram & 255, bit)
    keys, inverse = np.unique((gram >> 8 << 8) | node, return_inverse=True)
    zeros = np.bincount(inverse, weights=n * (1 - value), minlength=len(keys))
    ones = np.bincount(inverse, weights=n * value, minlength=len(keys))
    return Level(keys, np.zeros(0, dtype=np.int64), zeros, ones, log_kt(zeros, ones), np.ones(len(keys))), inverse


def shallower(below: Level, depth: int) -> Level:
    """The contexts of ``depth`` above the given ones; sets their ``parent``."""
    keys, below.parent = np.unique(below.keys & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
    n = len(keys)
    zeros = np.bincount(below.parent, weights=below.zeros, minlength=n)
    ones = np.bincount(below.parent, weights=below.ones, minlength=n)
    split = np.bincount(below.parent, weights=below.log_pw, minlength=n)
    log_pe = log_kt(zeros, ones)
    log_pw = np.logaddexp(HALF + log_pe, HALF + split)
    return Level(keys, np.zeros(0, dtype=np.int64), zeros, ones, log_pw, np.exp(HALF + log_pe - log_pw))


def descend(level: Level, one: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add a level to its parents' (probability of a one so far, weight that goes on)."""
    kt = (level.ones + 0.5) / (level.zeros + level.ones + 1.0)
    return one + reach * level.stop * kt, reach * (1 - level.stop)


def group_roots(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all grams of some contexts of GROUP bytes: those contexts' keys (context << 8 | node),
    counts and ln Pw."""
    out = []
    for bit in range(8):
        level, _ = leaves(gram, n, bit)
        for depth in range(DEPTH - 1, GROUP - 1, -1):
            level = shallower(level, depth)
        out.append((level.keys, level.zeros, level.ones, level.log_pw))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


@dataclass
class Top:
    """The mixture down to some depth: sorted keys, P(one) so far, weight left."""

    keys: np.ndarray
    one: np.ndarray
    reach: np.ndarray


def level_of(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray, depth: int) -> Level:
    """Contexts of ``depth`` by distinct keys, from their counts and the sums of ln Pw below them."""
    return shallower(Level(keys, np.zeros(0, dtype=np.int64), zeros, ones, split, np.ones(len(keys))), depth)


def roots(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray) -> Top:
    """The mixture down to the last byte, from sums by (last byte << 8 | node)."""
    below = level_of(keys, zeros, ones, split, 1)
    root = shallower(below, 0)
    one, reach = descend(root, np.zeros(len(root.keys)), np.ones(len(root.keys)))
    return Top(below.keys, *descend(below, one[below.parent], reach[below.parent]))


def go_down(top: Top, level: Level, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """P(one) and the weight left at a level, from those of ``depth`` above it."""
    at = np.searchsorted(top.keys, level.keys & ((1 << (8 * (depth + 1))) - 1))
    return descend(level, top.one[at], top.reach[at])


def group_scores(gram: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of each gram's last byte's probability given the bytes before it."""
    out = np.zeros(len(gram))
    for bit in range(8):
        leaf, inverse = leaves(gram, n, bit)
        levels = [leaf]
        for depth in range(DEPTH - 1, GROUP - 1, -1):
            levels.append(shallower(levels[-1], depth))
        at = np.searchsorted(top.keys, levels[-1].keys & ABOVE)
        one, reach = top.one[at], top.reach[at]
        for k, level in enumerate(reversed(levels)):
            if k:
                one, reach = one[level.parent], reach[level.parent]
            one, reach = descend(level, one, reach)
        _, value = node_of(gram & 255, bit)
        p = one[inverse]
        out += np.log10(np.where(value == 1, p, 1 - p))
    return out


class Lookup:
    """gram -> log10 probability, by a probe of an open table and a sorted rest; misses are told."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(gram)) * 2))))
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits)
        slot = self.slot(gram)
        self.keys[slot] = gram  # the last writer of a slot keeps it
        won = self.keys[slot] == gram
        self.values[slot[won]] = value[won]
        rest = np.flatnonzero(~won)
        order = rest[np.argsort(gram[rest], kind="stable")]
        self.rest_keys, self.rest_values = np.append(gram[order], -1), np.append(value[order], 0.0)

    def slot(self, gram: np.ndarray) -> np.ndarray:
        return ((gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and the places of those."""
        slot = self.slot(gram)
        out = self.values[slot]
        lost = np.flatnonzero(self.keys[slot] != gram)
        at = np.searchsorted(self.rest_keys[:-1], gram[lost])
        found = self.rest_keys[at] == gram[lost]
        out[lost] = np.where(found, self.rest_values[at], 0.0)
        return out, lost[~found]
