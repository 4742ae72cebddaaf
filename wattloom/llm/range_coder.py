"""An adaptive range coder for token ids, run over many independent blocks at once.

For every id three orders make their prediction: the id that last followed the two ids before (order 2), the one
before (order 1), and the shares of all ids, which are the same for all blocks and stand beside them (order 0).
Counts by the confidence of orders 2 and 1 are mixed into the odds of three cases: order 2 is right, order 1 is
right, none is; an id of the last case is coded by its share.  Contexts and counts start from nothing in each
block.  All blocks take each step together, as vectors over flat tables: an entry of a context table is
(id + 1) << 4 | confidence, an entry of the odds is three counts of 16 bits in one word.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: contexts by hash at most (as many as a block has ids), confidence levels, a count added at each step.
CONTEXTS, LEVELS, ADD_CASE = 1024, 8, 6
#: Ids in a block at most (counts stay below 2^16), and blocks that are coded at once: a step's calls cost what some
#: thousand ids do.
BLOCK, LANES = 4096, 16384
#: Shares sum to this; the last id never occurs, so that none has all.
WHOLE = 65536
_U = np.uint64
_LOW32, _TOP, _M16 = _U(0xFFFFFFFF), _U(1 << 32), _U(0xFFFF)
_CASE = np.array([ADD_CASE << 16 * k for k in range(3)], np.uint64)


def shares_of(ids: np.ndarray) -> np.ndarray:
    """The share of each id below WHOLE, at least 1 for those that occur."""
    count = np.bincount(ids, minlength=WHOLE)
    count[-1] = 1
    shares = (count > 0) + count * (WHOLE - np.count_nonzero(count)) // count.sum()
    shares[shares.argmax()] += WHOLE - shares.sum()
    return np.minimum(shares, WHOLE - 1).astype(np.uint16)


class _Coder:
    """64-bit range coding without carries, a word of 32 bits at a time, for n lanes."""

    def __init__(self, n: int, words: np.ndarray | None, most: int):
        self.low = np.zeros(n, np.uint64)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.encoding = words is None
        self.words = np.zeros((n, most), np.uint32) if words is None else words
        self.at = np.arange(n) * self.words.shape[1]
        self.flat = self.words.reshape(-1)
        if not self.encoding:
            self.code = self.words[:, 0].astype(np.uint64) << _U(32) | self.words[:, 1].astype(np.uint64)
            self.at += 2

    def settle(self, low: np.ndarray, span: np.ndarray) -> None:
        """Moves on the words that are settled in the first lanes."""
        m = len(low)
        self.low[:m], self.range[:m] = low, span
        need = np.flatnonzero(np.minimum(low ^ (low + span), span) < _TOP)
        while len(need):
            low, span = self.low.take(need), self.range.take(need)
            span = np.where((low ^ (low + span)) < _TOP, span, (_U(0) - low) & _LOW32) << _U(32)
            at = self.at.take(need)
            if self.encoding:
                self.flat[at] = low >> _U(32)
            else:
                self.code[need] = self.code.take(need) << _U(32) | self.flat.take(at)
            low = low << _U(32)
            self.at[need], self.low[need], self.range[need] = at + 1, low, span
            need = need[np.minimum(low ^ (low + span), span) < _TOP]


def _run(ids: np.ndarray, lengths: np.ndarray, coder: _Coder, shares: np.ndarray | None) -> None:
    """Codes, or fills in, the ids of all lanes; lengths don't rise from lane to lane."""
    n = len(lengths)
    contexts = min(CONTEXTS, 1 << max(0, ids.shape[1] - 1).bit_length())
    after = [np.zeros(n * contexts, np.uint32) for _ in range(2)]
    odds = [np.full(n * LEVELS, sum(4 << 16 * k for k in range(3)), np.uint64) for _ in range(2)]
    share = np.ones(WHOLE, np.uint64) if shares is None else shares.astype(np.uint64)
    start = np.cumsum(share) - share
    named = None if coder.encoding else np.repeat(np.arange(WHOLE), share.astype(np.int64))  # by place among the shares
    row = np.arange(n)
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if n else 0), side="left")
    steps = np.ascontiguousarray(ids.T) if coder.encoding else np.zeros((ids.shape[1], n), np.uint32)
    p1, p2, was = np.zeros(n, np.int64), np.zeros(n, np.int64), -1
    for step, m in enumerate(active.tolist()):
        if m != was:
            p1, p2, was = p1[:m], p2[:m], m
            c_row, l_row = row[:m] * contexts, row[:m] * LEVELS
        at1 = c_row + (p1 * 0x9E5 >> 2 & contexts - 1)
        at2 = c_row + ((p1 * 0x2F35 + p2 * 0x6A9) >> 3 & contexts - 1)
        e1, e2 = after[0].take(at1), after[1].take(at2)
        said1, said2, sure1, sure2 = e1 >> 4, e2 >> 4, e1 & 15, e2 & 15
        o1, o2 = l_row + sure1, l_row + sure2
        w1, w2 = odds[0].take(o1), odds[1].take(o2)
        w = w1 + w2
        # where the first two cases end; an order that says nothing, or the same as order 2, has no case
        a = (w & _M16) * (said2 > 0)
        b = a + (w >> _U(16) & _M16) * ((said1 > 0) & (said1 != said2))
        low, part = coder.low[:m], coder.range[:m] // (b + (w >> _U(32)))
        if coder.encoding:
            x = steps[step, :m]
            y = x + np.uint32(1)
            right2 = said2 == y
            right = right2 | (said1 == y)
        else:
            q = coder.code[:m] - low
            right2, right = q < part * a, q < part * b
        # a range of 2^32 has room for a case and a share before it is settled
        below = part * np.where(right2, _U(0), np.where(right, a, b))
        span = part * np.where(right2, a, np.where(right, b - a, w >> _U(32)))
        tail = span >> _U(16)
        if not coder.encoding:
            found = named.take(np.minimum((q - below) // tail, _M16).astype(np.int64), mode="clip")
            x = np.where(right2, said2 - np.uint32(1), np.where(right, said1 - np.uint32(1), found.astype(np.uint32)))
            y = x + np.uint32(1)
            steps[step, :m] = x
        below += np.where(right, _U(0), tail * start.take(x))
        coder.settle(low + below, np.where(right, span, tail * share.take(x)))
        add = _CASE.take(2 - right.view(np.int8) - right2)
        odds[0][o1], odds[1][o2] = w1 + add, w2 + add
        fresh = y << np.uint32(4)
        for table, where, e, said, sure in ((after[0], at1, e1, said1, sure1), (after[1], at2, e2, said2, sure2)):
            table[where] = np.where(said == y, e + (sure < LEVELS - 1), np.where(sure < 2, fresh, e - (sure + np.uint32(1) >> np.uint32(1))))
        p1, p2 = x.astype(np.int64), p1
    if not coder.encoding:
        ids[:] = steps.T


def encode_blocks(ids: np.ndarray, block: int, shares: np.ndarray | None = None) -> list[bytes]:
    """The code of each block of `block` ids (the last may be shorter); ids below 2^16 - 1, each with a share (None: even ones)."""
    out: list[bytes] = []
    for at in range(0, len(ids), block * LANES):
        part = ids[at : at + block * LANES]
        n = -(-len(part) // block)
        grid = np.zeros(n * block, np.uint32)
        grid[: len(part)] = part
        lengths = np.minimum(block, len(part) - np.arange(n) * block)
        coder = _Coder(n, None, block * 3 // 2 + 8)
        _run(grid.reshape(n, block), lengths, coder, shares)
        for half in range(2):
            coder.flat[coder.at] = coder.low >> _U(32)
            coder.low = coder.low << _U(32)
            coder.at += 1
        sizes = coder.at - np.arange(n) * coder.words.shape[1]
        out += [w[:k].astype("<u4").tobytes() for w, k in zip(coder.words, sizes.tolist())]
    return out


def decode_blocks(codes: list[bytes], total: int, block: int, shares: np.ndarray | None = None) -> np.ndarray:
    """The `total` ids of the blocks' codes, which were coded with the same shares."""
    out = []
    for at in range(0, len(codes), LANES):
        part = codes[at : at + LANES]
        n = len(part)
        lengths = np.minimum(block, total - (at + np.arange(n)) * block)
        words = np.zeros((n, max(map(len, part)) // 4 + 2), np.uint32)
        for k, c in enumerate(part):
            words[k, : len(c) // 4] = np.frombuffer(c, "<u4")
        grid = np.zeros((n, block), np.uint32)
        _run(grid, lengths, _Coder(n, words, 0), shares)
        out.append(grid.reshape(-1)[: int(lengths.sum())])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
