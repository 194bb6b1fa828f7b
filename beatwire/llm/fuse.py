"""Static binary-fuse filters over 64-bit keys, built and asked with numpy.

A filter answers "was this key in the set": never no for a key of the set, yes
for about one foreign key in 256. It takes nine bits or so a key.
"""

from __future__ import annotations

import math

import numpy as np

HEADER = 3  # seed, segment length, segment count, as 64-bit numbers


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _places(keys: np.ndarray, seed: int, segment: int, count: int):
    """Three slots in neighbouring segments for every key, and its fingerprint."""
    h = _mix(keys, seed)
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    mark = ((h ^ (h >> np.uint64(24))) & np.uint64(0xFF)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), mark


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slot that each key has to itself), or None when stuck."""
    n = slots.shape[1]
    load = np.zeros(size, np.int64)
    which = np.zeros(size, np.int64)  # xor of the keys that are left in a slot
    for row in slots:
        np.add.at(load, row, 1)
        np.bitwise_xor.at(which, row, np.arange(n))
    rounds, left = [], n
    free = np.flatnonzero(load == 1)
    while free.size:
        keys, at = np.unique(which[free], return_index=True)
        rounds.append((keys, free[at]))
        left -= keys.size
        for row in slots[:, keys]:
            np.subtract.at(load, row, 1)
            np.bitwise_xor.at(which, row, keys)
        touched = np.unique(slots[:, keys])
        free = touched[load[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of unsigned 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, keys.size)
    segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    slots_wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, math.ceil(slots_wanted / segment) - 2)
    seed = 0
    while True:
        seed += 1
        if seed % 20 == 0:
            count += 1
        slots, marks = _places(keys, seed, segment, count)
        rounds = _peel(slots, segment * (count + 2))
        if rounds is not None:
            break
    table = np.zeros(segment * (count + 2), np.uint8)
    for at, slot in reversed(rounds):
        a, b, c = slots[:, at]
        table[slot] = marks[at] ^ table[a] ^ table[b] ^ table[c]
    return np.array([seed, segment, count], np.uint64).tobytes() + table.tobytes()


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """For every key whether the filter may hold it."""
    seed, segment, count = (int(x) for x in np.frombuffer(filter_bytes, np.uint64, HEADER))
    table = np.frombuffer(filter_bytes, np.uint8, offset=8 * HEADER)
    (a, b, c), marks = _places(keys.astype(np.uint64), seed, segment, count)
    return (table[a] ^ table[b] ^ table[c]) == marks
