"""An FM-index over integer symbols: suffix order, wavelet matrix, sampled positions; all in numpy.

Symbol 0 separates runs. Separators are unique in the suffix order (by place), so suffixes never
compare beyond their run and prefix doubling ends after log2(longest run) rounds.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


class FmIndex:
    def __init__(self, symbols: np.ndarray):
        """symbols must end with 0."""
        n = len(symbols)
        self.n, self.sigma = n, int(symbols.max()) + 1
        seps = symbols == 0
        rank = np.where(seps, np.cumsum(seps) - 1, symbols.astype(np.int64) + int(seps.sum()))
        order = np.argsort(rank, kind="stable")
        k = 1
        while True:
            ranked = rank[order]
            new = np.empty(n, np.int64)
            second = np.zeros(n, np.int64)
            second[: n - k if k < n else 0] = rank[k:] + 1
            key = rank * (n + int(seps.sum()) + self.sigma + 2) + second
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            rank = new
            k *= 2
            if n == 0 or rank[order[-1]] == n - 1 or k > 2 * n:
                break
        self.order = order
        bwt = symbols[order - 1].copy()
        bwt[order == 0] = 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])
        # Positions kept: every SAMPLE_EVERY-th, and run starts, where a walk to the left must end.
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = seps[:-1]
        kept = (np.arange(n) % SAMPLE_EVERY == 0) | starts | seps
        self.sampled = kept[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]
        del self.order
        self._wavelet(bwt)
        self.bwt = bwt

    def _wavelet(self, values: np.ndarray) -> None:
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first upto places of the transformed text."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            lo1, hi1 = self.ones[i][lo], self.ones[i][hi]
            lo = np.where(one, self.zeros[i] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[i] + hi1, hi - hi1)
        return hi - lo

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [sp, ep) of the patterns text[start : start + length], from their last symbol backwards."""
        sp = np.zeros(len(starts), np.int64)
        ep = np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for j in range(length - 1, -1, -1):
            c = text[starts[live] + j].astype(np.int64)
            fine = c < self.sigma
            c = np.where(fine, c, 0)
            base = self.before[c]
            s = base + self.rank(c, sp[live])
            e = np.where(fine, base + self.rank(c, ep[live]), s)
            sp[live], ep[live] = s, e
            live = live[e > s]
            if not len(live):
                break
        return sp, ep

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk left until a sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            r = rows[live]
            c = self.bwt[r].astype(np.int64)
            rows[live] = self.before[c] + self.rank(c, r.astype(np.int64))
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.samples[self.sample_rank[rows]] + steps
