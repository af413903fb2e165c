"""An FM-index over a sequence of word ids, with NumPy: suffix array, wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

#: Bits a rank has when three are packed into one sort key; bounds the length of an indexed text.
RANK_BITS = 21
MAX_LENGTH = (1 << RANK_BITS) - 4
SAMPLE = 32


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by sorting first on three symbols and then, among ties only, on three times the depth."""
    n = len(text)
    if n > MAX_LENGTH:
        raise ValueError(f"at most {MAX_LENGTH} symbols")
    at = np.zeros(n + 2, np.int64)
    at[:n] = text.astype(np.int64) + 1
    key = (at[:n] << 2 * RANK_BITS) | (at[1 : n + 1] << RANK_BITS) | at[2:]
    sa = np.argsort(key)
    spots, suffixes, ordered, depth = np.arange(n), sa, key[sa], 3
    rank = np.zeros(n + 1, np.int64)  # 1 + the first place of its group; 0 past the end
    while True:
        first = np.ones(len(spots), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        rank[suffixes] = np.maximum.accumulate(np.where(first, spots, 0)) + 1
        tied = ~first
        tied[:-1] |= ~first[1:]
        if not tied.any():
            return sa
        spots, suffixes = spots[tied], suffixes[tied]
        key = (rank[suffixes] << 2 * RANK_BITS) | (rank[np.minimum(suffixes + depth, n)] << RANK_BITS) | rank[np.minimum(suffixes + 2 * depth, n)]
        order = np.argsort(key)
        suffixes, ordered = suffixes[order], key[order]
        sa[spots] = suffixes
        depth *= 3


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed.view(np.uint8)[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for level in range(depth - 1, -1, -1):
            bits = (symbols >> level) & 1 != 0
            self.levels.append(Bits(bits))
            kept = symbols[~bits]
            self.zeros.append(len(kept))
            symbols = np.concatenate((kept, symbols[bits]))

    def spot(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence leads if it is followed down the bits of each symbol."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = np.where((symbols >> (self.depth - 1 - level)) & 1 != 0, zeros + ones, i - ones)
        return i

    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and where they lead."""
        symbols = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.ones(i)
            symbols = (symbols << 1) | one
            i = np.where(one, zeros + ones, i - ones)
        return symbols, i


class Phrases:
    """Phrases as stretches of one array of symbols; symbols that the text lacks are -1."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.symbols, self.ends, self.lengths = symbols, starts + lengths - 1, lengths

    def __len__(self) -> int:
        return len(self.lengths)

    def from_end(self, which: np.ndarray, step: int) -> np.ndarray:
        """The symbol that many steps before the last one of each phrase."""
        return self.symbols[self.ends[which] - step]


class FMIndex:
    """Of a text of symbols 1.. ; symbol 0 is kept for its end."""

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text, 0).astype(np.int32)
        sa = suffix_array(text)
        self.n, self.alphabet = len(text), alphabet
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        self.tree = WaveletMatrix(text[sa - 1], max(1, int(alphabet - 1).bit_length()))
        sampled = sa % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), sa[sampled]

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once. Returns row intervals, empty ones for phrases that do not occur."""
        lo, hi = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        live = np.flatnonzero(phrases.lengths > 0)
        symbols = phrases.from_end(live, 0)
        live, symbols = live[symbols >= 0], symbols[symbols >= 0]
        lo[live], hi[live] = self.starts[symbols], self.starts[symbols + 1]
        for step in range(1, int(phrases.lengths.max(initial=0))):
            live = live[hi[live] > lo[live]]
            now = live[phrases.lengths[live] > step]
            if not len(now):
                break
            symbols = phrases.from_end(now, step)
            hi[now[symbols < 0]] = lo[now[symbols < 0]]
            now, symbols = now[symbols >= 0], symbols[symbols >= 0]
            base = self.starts[symbols] - self.tree.spot(symbols, np.zeros(len(now), np.int64))
            lo[now], hi[now] = base + self.tree.spot(symbols, lo[now]), base + self.tree.spot(symbols, hi[now])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled suffix."""
        found, rows, walked = np.zeros(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            here = self.sampled.get(rows[left])
            done = left[here]
            found[done] = self.samples[self.sampled.ones(rows[done])] + walked
            left = left[~here]
            if len(left):
                symbols, spots = self.tree.follow(rows[left])
                rows[left] = self.starts[symbols] + spots - self.tree.spot(symbols, np.zeros(len(left), np.int64))
            walked += 1
        return found
