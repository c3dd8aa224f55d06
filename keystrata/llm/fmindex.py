"""An FM-index over the texts of one shard, in NumPy: suffix array, wavelet matrix over the BWT, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SEP = 0


def suffix_array(t: np.ndarray, sep_after: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. Each separator is its own symbol, ordered by place, below all others.

    `sep_after[i]` is the place of the first separator at or after i. Prefixes of 8 bytes are sorted once; after that only
    suffixes that are still tied are sorted again, by the rank of what follows, with doubled length each time.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n])
    left = np.minimum(sep_after - np.arange(n), 8)  # bytes up to the separator; what follows it doesn't count
    masks = np.array([((1 << 64) - 1) ^ ((1 << 8 * (8 - k)) - 1) for k in range(9)], dtype=np.uint64)
    key = eight.view(">u8").ravel().astype(np.uint64) & masks[left]
    seps = np.flatnonzero(t == SEP)
    key[seps] = np.arange(len(seps), dtype=np.uint64)
    sa = np.argsort(key).astype(np.int32)
    sorted_key = key[sa]
    first = np.ones(n + 1, dtype=bool)  # the first of its group of equal ones
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:n])
    tied = np.flatnonzero(~(first[:-1] & first[1:])).astype(np.int32)
    start = np.flatnonzero(first[:-1]).astype(np.int32)
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.repeat(start, np.diff(np.append(start, n)))
    h = 8
    while len(tied):
        sub = sa[tied]
        both = (rank[sub].astype(np.int64) << 32) | rank[np.minimum(sub.astype(np.int64) + h, sep_after[sub])]
        order = np.argsort(both)
        sub, both = sub[order], both[order]
        sa[tied] = sub
        new = np.ones(len(sub) + 1, dtype=bool)
        np.not_equal(both[1:], both[:-1], out=new[1:-1])
        rank[sub] = np.maximum.accumulate(np.where(new[:-1], tied, 0))
        tied = tied[~(new[:-1] & new[1:])]
        h *= 2
    return sa


class BitVector:
    """Bits with rank: packed words and the number of set bits before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits in [0, i)."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols with rank and access in as many steps as a symbol has bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        s = symbols
        for shift in range(bits - 1, -1, -1):
            b = (s >> shift) & 1
            self.levels.append((shift, BitVector(b.astype(bool)), int(len(s) - b.sum())))
            s = np.concatenate([s[b == 0], s[b == 1]])
        self.begin = self._go(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))

    def _go(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, v, zeros in self.levels:
            ones = v.rank(i)
            i = np.where((c >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each c before each i."""
        return self._go(c, i) - self.begin[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each i and its occurrences before i."""
        c = np.zeros(len(i), dtype=np.int64)
        for shift, v, zeros in self.levels:
            one = v.get(i)
            ones = v.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.begin[c]


class FMIndex:
    """Texts without zero bytes, joined by separators."""

    def __init__(self, texts: list[bytes], sample: int = 32):
        t = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        n = len(t)
        lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        sep_after = np.repeat(self.starts + lengths, lengths + 1)
        used = np.unique(t)
        self.code = np.full(256, -1, dtype=np.int64)
        self.code[used] = np.arange(len(used))
        sa = suffix_array(t, sep_after)
        bwt = self.code[t[sa - 1]]
        self.matrix = WaveletMatrix(bwt.astype(np.uint8), max(1, int(len(used) - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.code[t], minlength=len(used)))])
        kept = sa % sample == 0
        begins = np.zeros(n, dtype=bool)
        begins[self.starts] = True
        kept |= begins[sa]
        self.kept = BitVector(kept)
        self.positions = sa[kept]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (bytes, one a row, padded at the end) at once: their intervals [lo, hi)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.flatnonzero(lengths > 0)
        step = 0
        while len(live):
            c = self.code[patterns[live, lengths[live] - 1 - step]]
            known = c >= 0
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live], hi[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            step += 1
            live = live[(hi[live] > lo[live]) & (lengths[live] > step)]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: step back until a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.kept.get(at)
            out[open_[done]] = self.positions[self.kept.rank(at[done])] + steps
            open_, at = open_[~done], at[~done]
            c, r = self.matrix.access_rank(at)
            at = self.first[c] + r
            steps += 1
        return out

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The number of the text in which each position lies."""
        return np.searchsorted(self.starts, positions, side="right") - 1
