"""The best path of tokens through a frame by token grid. State 2 i is the blank before token i, state 2 i + 1 the token; a blank between two
tokens that differ may be left out. Of equal paths the one counts that stays, then the one that comes from the state before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Frames whose moves are packed into bits together, after which states are left out.
BLOCK = 128
#: What a path is first allowed to lose, in what frames lose on the average to their second likeliest label: so much for each token that finds no frame of its own, so much
#: besides, and so many times the least that is lost by what is heard beside the text; and by what this is multiplied until a path keeps within it. None of these bears on the result.
SPARE, RAISED = (1.5, 6.0, 1.02), (1, 2, 4)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows of numbers; of lists of such lists, one after the other."""
    lists = column.combine_chunks()
    if pa.types.is_list(lists.type.value_type):
        lists = lists.flatten()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def sure_states(grid: np.ndarray, tokens: np.ndarray, blank: int) -> np.ndarray | None:
    """The states of the likeliest token of each frame, where these read as the tokens and no frame has a second as likely: every other path loses
    more than rounding could. None elsewhere, which says nothing about the best path."""
    label = grid.argmax(axis=1)
    sounds = label != blank
    new = sounds.copy()
    new[1:] &= label[1:] != label[:-1]
    if not np.array_equal(label[new], tokens):
        return None
    top = grid[np.arange(len(grid)), label]
    close = 4 * len(grid) * np.finfo(float).eps * max(1.0, np.abs(top).sum())
    if not np.isfinite(close) or np.count_nonzero(grid >= (top - close)[:, None]) != len(grid):
        return None
    return 2 * np.cumsum(new) - sounds


class _Bound:
    """What each state at the end of a block of frames has lost against the likeliest of the text's labels, and must lose yet: a token that finds no frame of its own among the
    likeliest labels that follow, in order, takes one from another label, and so many frames at least lose as much as the cheapest of all. What exceeds
    the limit is on no path that loses less."""

    def __init__(self, grid: np.ndarray, tokens: np.ndarray, ends: list[int], low: np.ndarray, width: int, blank: int):
        labels = np.unique(np.append(tokens, blank))
        known, own = grid[:, labels], np.searchsorted(labels, tokens)
        rows, silent = np.arange(len(grid)), int(np.searchsorted(labels, blank))
        self.label = known.argmax(axis=1)
        self.top = known[rows, self.label]
        known[rows, self.label] = -np.inf
        self.past, self.n, self.own, self.silent = np.cumsum(self.top), len(tokens), own, silent
        self.close = 4 * len(grid) * np.finfo(float).eps * max(1.0, np.abs(self.top).sum())
        self.sure = bool(np.isfinite(self.close))
        if not self.sure:
            return
        self.gap = self.top - known.max(axis=1)
        self.cost = np.append(0, np.cumsum(np.sort(self.gap)))
        change = np.flatnonzero(np.r_[True, self.label[1:] != self.label[:-1]])
        runs, last = self.label[change], np.append(change[1:], len(grid)) - 1
        runs, last = runs[runs != silent], last[runs != silent]
        # Bit q of a row is 0 where the q-th last token adds to what the last tokens have in common with the last runs.
        places = dict.fromkeys(range(len(labels)), 0)
        for q, x in enumerate(own[::-1].tolist()):
            places[x] |= 1 << q
        full, self.rows = (1 << self.n) - 1, {}
        row, wanted, at = full, np.searchsorted(last, ends).tolist(), len(runs)
        # Of runs that no token has to itself each costs a frame too: its own, or one before it, where the token that has it stays from an earlier run; without blanks
        # between the runs these can be the same.
        self.part, self.left = 1 if np.count_nonzero(self.label[change[1:] - 1] == silent) + np.count_nonzero(self.label[change[1:]] == silent) >= len(change) - 1 else 2, dict(zip(ends, (len(runs) - np.array(wanted, int)).tolist()))
        heard = runs.tolist()
        for end, j in sorted(zip(ends, wanted), reverse=True):
            for x in reversed(heard[j:at]):
                hit = row & places[x]
                row = ((row + hit) | (row - hit)) & full
            at = min(at, j)
            # Of a row what bears on the states within reach, else rows would grow with the square of a recording's length.
            least, most = self.n - (int(low[end - 1]) + width) // 2, self.n - (int(low[end - 1]) + 1) // 2
            self.rows[end] = least, (row & ((1 << least) - 1)).bit_count(), most - least, row >> least & ((1 << most - least) - 1)
        for x in reversed(heard[:at]):
            hit = row & places[x]
            row = ((row + hit) | (row - hit)) & full
        finite = self.gap[np.isfinite(self.gap)]
        alone = self.cost[min((len(runs) - self.n + row.bit_count()) // self.part, len(grid))]
        self.limit = (finite.mean() if len(finite) else 1.0) * (SPARE[0] * row.bit_count() + SPARE[1]) + SPARE[2] * alone

    def lost(self, scores: np.ndarray, first: int, end: int) -> np.ndarray:
        """The least that paths through these states, from the first on, lose in all, the frames before end being past."""
        least, known, size, bits = self.rows[end]
        bits = np.unpackbits(np.frombuffer(bits.to_bytes(size // 8 + 1, "little"), np.uint8), count=size, bitorder="little")
        after = self.n - (np.arange(first, first + len(scores)) + 1) // 2
        missed = (known + np.append(0, np.cumsum(bits, dtype=np.int64)))[np.clip(after - least, 0, size)]
        most = np.maximum(missed, (self.left[end] - after + missed) // self.part)
        return self.past[end - 1] - scores + self.cost[np.minimum(most, len(self.cost) - 1)]

    def ending(self, low: np.ndarray, width: int) -> np.ndarray:
        """The states of the likeliest labels from the first frame on from which these read as the last tokens and lie where they may; -1 before."""
        sounds = self.label != self.silent
        new = sounds.copy()
        new[1:] &= self.label[1:] != self.label[:-1]
        after = np.cumsum(new[::-1])[::-1]  # tokens that begin at a frame or later
        token = self.n - 1 - (after - new)
        state = np.where(sounds, 2 * token + 1, 2 * (self.n - after))
        # A frame goes wrong where its label is no token's, has one as likely, or is not where it may be.
        wrong = (sounds & ((token < 0) | (self.own[np.maximum(token, 0)] != self.label))) | (self.gap <= self.close) | (state < low) | (state >= low + width) | (after > self.n)
        state[: (np.flatnonzero(wrong)[-1] + 1) if wrong.any() else 0] = -1
        return state


def best_states(grid: np.ndarray, tokens: np.ndarray, low: np.ndarray, width: int, blank: int) -> np.ndarray | None:
    """The states of the best path that at each frame is in the width states from low on, which never falls; None where none gets through. States are left out as soon
    as no path through them can lose as little as a limit; the limit is raised until a path keeps within it, which is then the best of all."""
    bound = _Bound(grid, tokens, list(range(BLOCK, len(grid), BLOCK)), low, width, blank)
    for limit in [bound.limit * x for x in RAISED if bound.sure] + [np.inf]:
        found = _best_within(grid, tokens, low, width, blank, bound, limit)
        if found is not None:
            return found
    return None


def _best_within(grid: np.ndarray, tokens: np.ndarray, low: np.ndarray, width: int, blank: int, bound: _Bound, limit: float) -> np.ndarray | None:
    """best_states() of the paths that lose no more than the limit; None where there are none, or a state that is left out could bear on one."""
    n, frames = len(tokens), len(grid)
    token = np.full(2 * n + 1, blank, np.int64)
    token[1::2] = tokens
    # What is added to the score of the state two before: a blank between two tokens that differ may be left out, nothing else.
    skip = np.full(2 * n + 1, -np.inf)
    skip[3::2][tokens[1:] != tokens[:-1]] = 0.0
    # scores[s + 2] is state s; those that are not within the frame's are -inf.
    scores = np.full(2 * n + 3, -np.inf)
    begin, ending = low.tolist(), bound.ending(low, width) if limit < np.inf else None
    lowest, past, packed, tail = 0, 2, [], None
    for t0 in range(0, frames, BLOCK):
        t1 = min(frames, t0 + BLOCK)
        # The block's states, from the first on: a frame adds two at most.
        first, end = max(lowest, begin[t0]), min(2 * n + 1, past + 2 * (t1 - t0), begin[t1 - 1] + width)
        size = end - first
        if size <= 0:
            return None
        sounds = grid[t0:t1].take(token[first:end], axis=1)
        here, step, before, hops = scores[first + 2 : end + 2], scores[first + 1 : end + 1], scores[first:end], skip[first:end]
        best, hop = np.empty(size), np.empty(size)
        stepped, hopped = np.zeros((t1 - t0, size), bool), np.zeros((t1 - t0, size), bool)
        inside = begin[t1 - 1] <= first and end <= begin[t0] + width
        for k, (steps, skips, heard) in enumerate(zip(stepped, hopped, sounds)):
            if t0 or k:
                np.greater(step, here, steps)
                np.maximum(here, step, best)
                np.add(before, hops, hop)
                np.greater(hop, best, skips)
                np.maximum(best, hop, best)
                np.add(best, heard, here)
            else:
                here[: max(0, 2 - first)] = heard[: max(0, 2 - first)]
            if not k:
                scores[lowest + 2 : first + 2] = -np.inf  # their last frame was the one before
            if not inside:
                a = begin[t0 + k]
                here[: max(0, a - first)] = -np.inf
                here[max(0, a + width - first) :] = -np.inf
        packed.append((first, np.packbits(stepped, axis=1), np.packbits(hopped, axis=1)))
        lowest, past = first, end
        if limit < np.inf and t1 < frames:
            lost, most = bound.lost(here, first, t1), limit
            sure = int(ending[t1 - 1])
            if first <= sure < end:  # from here on this path loses nothing more
                most = min(most, float(lost[sure - first]))
            left = np.flatnonzero(lost <= most + bound.close)
            if not len(left):
                return None
            lowest, past = first + int(left[0]), first + int(left[-1]) + 1
            here[: lowest - first] = here[past - first :] = -np.inf
            if lowest == sure == past - 1:
                tail = ending[t1:]
                break
    if tail is None:
        tail, s = np.zeros(0, np.int64), 2 * n - int(scores[2 * n + 2] < scores[2 * n + 1])
        if not np.isfinite(scores[s + 2]) or bound.sure and bound.past[-1] - scores[s + 2] > limit:
            return None
    else:
        s = lowest
    path = np.empty(frames, np.int64)
    path[frames - len(tail) :] = tail
    for block in range(len(packed) - 1, -1, -1):
        first, *moves = packed[block]
        t0, low_i = block * BLOCK, max(0, s - first - 2 * BLOCK)
        stepped, hopped = (np.unpackbits(m, axis=1, count=s - first + 1)[:, low_i:] for m in moves)
        back, width = np.where(hopped, 2, stepped).astype(np.uint8).tobytes(), hopped.shape[1]
        base = first + low_i
        for k in range(len(hopped) - 1, -1, -1):
            path[t0 + k] = s
            s -= back[k * width + s - base]
    return path


def token_frames(path: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last frame of each of n tokens."""
    heard = np.flatnonzero(path % 2 == 1)
    token = path[heard] // 2
    return heard[np.searchsorted(token, np.arange(n))], heard[np.searchsorted(token, np.arange(n), "right") - 1]
