"""A compressed FM-index over word sequences: suffix array, Burrows-Wheeler transform, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

U = np.uint64


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes sorted by their first ``depth`` codes or more (ties by place), and by length 2**k the ranks of all substrings of that length."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    ranks, length = {1: rank}, 1
    while length < depth:
        after = np.zeros_like(rank)
        after[:-length] = rank[length:] + 1
        pair = rank * (len(rank) + 1) + after
        rank = np.unique(pair, return_inverse=True)[1]
        length *= 2
        ranks[length] = rank
        if rank.max(initial=0) + 1 == len(rank):
            break
    return np.argsort(rank, kind="stable"), ranks


class WaveletMatrix:
    """Rank of any code in any prefix, in one bit vector for each bit of the codes."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (codes >> level) & 1
            raw = np.packbits(bit.astype(bool), bitorder="little")
            word = np.frombuffer(raw.tobytes() + bytes(16 - len(raw) % 8), U)
            self.words.append(word)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word))]).astype(np.int64))
            self.zeros.append(int(len(codes) - bit.sum()))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def down(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix ends land on the lowest level when codes are followed."""
        for k in range(self.bits):
            block = at >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.words[k][block] & ((U(1) << (at & 63).astype(U)) - U(1)))
            at = np.where((codes >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Counts of code sequences in a text of codes (0 separates parts and is never searched for)."""

    def __init__(self, codes: np.ndarray, depth: int):
        order, self.ranks = suffix_order(codes, depth)
        self.matrix = WaveletMatrix(codes[order - 1])
        every = np.arange(int(codes.max(initial=0)) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(every)))])[:-1]
        self.base = self.matrix.down(every, np.zeros(len(every), np.int64))
        self.size = len(codes)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of sequences with a code put before them."""
        shift = self.first[code] - self.base[code]
        return shift + self.matrix.down(code, low), shift + self.matrix.down(code, high)


def repeated_windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each place of codes: does a window that starts there, inside one of the parts, occur twice or more?

    Matching statistics by backward search: from the right end of a run of windows the match is extended to
    the left while it occurs twice.  Windows that hold a substring of 8 codes which the suffix ranks show to
    be unique are passed over.
    """
    index = FMIndex(codes, 2 * window)
    out = np.zeros(len(codes), bool)
    alive = np.zeros(len(codes) + 1, np.int64)
    rank = index.ranks.get(8)
    if rank is None:
        rank = index.ranks[max(index.ranks)]
    twice = np.bincount(rank)[rank] > 1
    bad = np.concatenate([[0], np.cumsum(~twice)])
    valid = np.zeros(len(codes), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= window:
            valid[a : b - window + 1] = True
    full = np.flatnonzero(valid)
    clear = bad[full + window - 7] - bad[full] == 0
    alive[full[clear]] = 1
    edge = np.diff(alive, prepend=0)
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)  # windows first to last (exclusive)
    left, right = runs[:, 0], runs[:, 1] - 1 + window  # of each run: leftmost place, right end of its last window
    while len(left):
        at = right.copy()
        low, high = np.zeros(len(at), np.int64), np.full(len(at), index.size)
        going = np.arange(len(at))
        while len(going):
            c = codes[at[going] - 1]
            a, b = index.extend(c, low[going], high[going])
            ok = b - a >= 2
            going, a, b = going[ok], a[ok], b[ok]
            low[going], high[going] = a, b
            at[going] -= 1
            going = going[at[going] > left[going]]
        long = right - at >= window
        marks = np.zeros(len(codes) + 1, np.int64)
        np.add.at(marks, at[long], 1)
        np.add.at(marks, right[long] - window + 1, -1)
        out |= np.cumsum(marks[:-1]) > 0
        right = np.where(at > left, right - 1, 0)  # windows further to the left need another right end
        keep = right - left >= window
        left, right = left[keep], right[keep]
    return out
