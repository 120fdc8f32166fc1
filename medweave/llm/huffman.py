"""Canonical Huffman codes of bounded length, packing and table-driven unpacking of ids."""

from __future__ import annotations

import numpy as np

MOST_BITS = 25  # a code that begins in any bit of a byte then lies in four bytes


def code_lengths(weights: np.ndarray, max_bits: int) -> np.ndarray:
    """Bits of each symbol's code, by package merge; all weights above 0."""
    n = len(weights)
    if max_bits > MOST_BITS:
        raise ValueError(f"codes have at most {MOST_BITS} bits")
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(weights, kind="stable")
    coins = weights[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([coins, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(np.cumsum(rank < n))  # symbols among the first entries
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for among in reversed(levels):
        symbols = int(among[take - 1]) if take else 0
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Code:
    """The canonical code of ``ids`` (ascending) with ``bits`` each: shorter codes first, then smaller ids."""

    def __init__(self, ids, bits) -> None:
        self.ids, self.bits = np.asarray(ids, np.int64), np.asarray(bits, np.int64)
        self.longest = int(self.bits.max()) if len(self.bits) else 1
        self.order = np.lexsort((self.ids, self.bits))
        sizes = np.left_shift(1, self.longest - self.bits[self.order])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)  # codes, filled up with zeros on the right
        self.sizes = sizes
        dense = int(self.ids[-1]) + 1 if len(self.ids) else 0
        self.code_of, self.bits_of = np.zeros(dense, np.uint64), np.zeros(dense, np.int64)  # by id
        self.code_of[self.ids[self.order]] = first >> (self.longest - self.bits[self.order])
        self.bits_of[self.ids] = self.bits

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """Packed bits, and where the codes of each ``every``-th id begin.

        A code lies in two neighbouring 32-bit words at most, and codes share no bit: words are sums of their parts.
        """
        bits, codes = self.bits_of[ids], self.code_of[ids]
        begins = np.cumsum(bits) - bits
        total = int(begins[-1] + bits[-1]) if len(ids) else 0
        word = begins >> 5
        spread = codes << (64 - bits - (begins & 31)).astype(np.uint64)
        words = np.bincount(word, (spread >> np.uint64(32)).astype(np.float64), total // 32 + 2)
        words += np.bincount(word + 1, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
        return words.astype(">u4").tobytes()[: -(-total // 8)], begins[::every].copy()

    def table(self) -> np.ndarray:
        """For every value of the next ``longest`` bits, the symbol above the low five bits and the code's bits in them."""
        known = np.repeat((self.ids[self.order] << 5 | self.bits[self.order]).astype(np.uint32), self.sizes)
        return np.concatenate([known, np.ones((1 << self.longest) - len(known), np.uint32)])

    def decode(self, packed: bytes, begins: np.ndarray, n: int, every: int, table: np.ndarray | None = None) -> np.ndarray:
        """The ids; the runs between checkpoints are decoded side by side, one id of each per step."""
        table = self.table() if table is None else table
        raw = np.frombuffer(packed + bytes(4), np.uint8).astype(np.uint32)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from every byte on
        at, out = begins.astype(np.int64), np.zeros((every, len(begins)), np.uint32)
        down, last = np.uint32(32 - self.longest), len(four) - 1
        for step in range(every):
            found = table[(four[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> down]
            out[step] = found >> 5
            at += found & 31
        return out.T.reshape(-1)[:n]
