"""A minimal perfect hash of 64-bit keys: each of n keys gets an index of its own below n.

Levels of bits: a key that is alone at its place of a level has its bit set there; the others go on to the next level,
with another seed.  A key's index is the number of bits before its own.  About four bits a key; a key that isn't in
the set gets some index too, or -1, so callers compare the stored key at it.
"""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype("<u8")
#: Places of a level for each key that it gets.
SPREAD = 2


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> bytes:
    """The hash of these keys, which must be distinct."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        size = max(8, -(-SPREAD * len(left) // 8) * 8)
        place = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[place]]
    head = np.array([len(levels), *map(len, levels)], _HEAD)
    return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in levels)


class PerfectHash:
    """build()'s bytes, ready to be asked."""

    def __init__(self, raw: bytes):
        count = int(np.frombuffer(raw, _HEAD, 1)[0])
        self.sizes = np.frombuffer(raw, _HEAD, count, 8)
        at, before, self.levels = 8 * (1 + count), 0, []
        for size in self.sizes.tolist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, size // 8, at)).astype(bool)
            rank = np.cumsum(bits) - bits + before
            self.levels.append((bits, rank))
            before += int(bits.sum())
            at += size // 8
        self.n = before

    def __len__(self) -> int:
        return self.n

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; -1 where every level turns it away."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            place = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return out

    def verified(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Each key's index where the key stored there is the same one, else -1."""
        at = self.index(keys)
        if not self.n:
            return at
        return np.where((at >= 0) & (stored[at] == keys.astype(np.uint64)), at, -1)
