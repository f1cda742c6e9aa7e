"""Canonical length-limited Huffman codes over integer symbols: building, coding and table-driven decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Longest code. The decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Ids between two checkpoints of a block.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code without codes longer than limit, by package-merge; 0 for counts of 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes longer than {limit}")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.int64)
    level, leaves = coins, [np.ones(len(coins), bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((coins, packages))
        place = np.argsort(both, kind="stable")
        level = both[place]
        leaves.append(place < len(coins))
    depth, take = np.zeros(len(coins), np.int64), 2 * len(coins) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    longest = int(size.max(initial=0))
    # A code is the sum of the shares 2 ** -length of the codes before it.
    share = np.int64(1) << (longest - size)
    codes[order] = (np.cumsum(share) - share) >> (longest - size)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids' bits, first bit highest, and the bit offsets of every STRIDE-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    # Each code falls into the 64 bits that begin at its 32-bit word; codes of one word are added up.
    word = start >> 5
    value = codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(value, heads) if len(heads) else np.zeros(0, np.uint64)
    out = np.zeros((total >> 5) + 2, np.uint32)
    at = word[heads]
    out[at] += (sums >> np.uint64(32)).astype(np.uint32)
    out[at + 1] += (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], start[::STRIDE].astype(np.uint32 if total < 1 << 32 else np.uint64)


@dataclass
class Decoder:
    symbols: np.ndarray
    sizes: np.ndarray
    bits: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Decoder:
        """The table from the next `bits` bits to the symbol that they begin with and its length."""
        bits = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        runs = np.int64(1) << (bits - lengths[order].astype(np.int64))
        symbols, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
        symbols[: runs.sum()], sizes[: runs.sum()] = np.repeat(order, runs), np.repeat(lengths[order], runs)
        return cls(symbols, sizes, bits)

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> np.ndarray:
        """The ids of (bits, checkpoints, number of ids) blocks, one after the other.

        All stretches between checkpoints are decoded side by side, one id of each at a time.
        """
        base, lanes, left, at = 0, [], [], []
        for payload, marks, n in blocks:
            lanes.append(marks.astype(np.int64) + 8 * base)
            full = np.full(len(marks), STRIDE, np.int64)
            if n:
                full[-1] = n - STRIDE * (len(marks) - 1)
            left.append(full)
            at.append(payload)
            base += len(payload)
        raw = np.frombuffer(b"".join([*at, bytes(8)]), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        place, left = np.concatenate([np.zeros(0, np.int64), *lanes]), np.concatenate([np.zeros(0, np.int64), *left])
        first = np.cumsum(left) - left
        out = np.empty(int(left.sum()), np.uint32)
        shift = np.uint32(32 - self.bits)
        # Longest stretches first: those that have ended are a tail.
        order = np.argsort(-left, kind="stable")
        place, first, left = place[order], first[order], left[order]
        for step in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -step, side="left"))
            p = place[:n]
            code = (window[p >> 3] << (p & 7).astype(np.uint32)) >> shift
            out[first[:n] + step] = self.symbols[code]
            place[:n] = p + self.sizes[code]
        return out
