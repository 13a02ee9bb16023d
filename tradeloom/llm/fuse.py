"""Static binary fuse filters (three-wise, 8-bit fingerprints) built with numpy.

A filter holds a fixed set of 64-bit keys in about 1.13 bytes each. It never misses a key and
answers "maybe" for about 1 in 256 others. Building peels keys off slots that only they use,
all such slots of a round at once, and then fills fingerprints in the reverse order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from tradeloom.llm.text import U64, mix


@dataclass(frozen=True)
class Fuse:
    seed: int
    segment: int  # slots per segment, a power of two
    span: int  # slots a key's first position is taken from
    prints: np.ndarray  # uint8

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], U64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        slots, own = _slots(keys, self.seed, self.segment, self.span)
        return own == np.bitwise_xor.reduce(self.prints[slots], axis=1)


def _slots(keys: np.ndarray, seed: int, segment: int, span: int):
    """The three slots of each key, in neighbouring segments, and its fingerprint."""
    h = mix(keys + U64(seed) * U64(0x9E3779B97F4A7C15))
    low = U64(segment - 1)
    first = ((h >> U64(32)) * U64(span)) >> U64(32)
    second = (first + U64(segment)) ^ ((h >> U64(14)) & low)
    third = (first + U64(2 * segment)) ^ (h & low)
    prints = (mix(h) & U64(0xFF)).astype(np.uint8)
    return np.stack([first, second, third], 1).astype(np.int64), prints


def build(keys: np.ndarray) -> Fuse:
    """A filter of the distinct keys."""
    keys = np.unique(keys.astype(U64))
    n = len(keys)
    if not n:
        return Fuse(0, 1, 1, np.zeros(0, np.uint8))
    segment = 4 if n == 1 else min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    seed = 0
    while True:
        span = max(1, math.ceil(n * factor / segment) - 2) * segment
        slots, prints = _slots(keys, seed, segment, span)
        rounds = _peel(slots, span + 2 * segment)
        if rounds is not None:
            break
        seed += 1
        if seed % 10 == 0:
            factor *= 1.1
    table = np.zeros(span + 2 * segment, np.uint8)
    for own, slot in reversed(rounds):
        table[slot] = prints[own] ^ np.bitwise_xor.reduce(table[slots[own]], axis=1)
    return Fuse(seed, segment, span, table)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each key alone uses by then), or None if keys are left over."""
    used = np.bincount(slots.ravel(), minlength=size)
    who = np.zeros(size, np.int64)  # exclusive or of the keys that use the slot
    np.bitwise_xor.at(who, slots.ravel(), np.repeat(np.arange(len(slots)), 3))
    rounds, left = [], len(slots)
    alone = np.flatnonzero(used == 1)
    while len(alone):
        own, at = np.unique(who[alone], return_index=True)
        rounds.append((own, alone[at]))
        left -= len(own)
        touched = slots[own].ravel()
        np.subtract.at(used, touched, 1)
        np.bitwise_xor.at(who, touched, np.repeat(own, 3))
        touched = np.unique(touched)
        alone = touched[used[touched] == 1]
    return None if left else rounds
