"""Best paths against the plain trellis, whole and in corridors, and what is sure without one."""

import numpy as np
import pytest

from talkgrid import plans
from talkgrid.functions import trellis
from talkgrid.operators import folds

SF = "/root/testdata/sf0.001"


def plain_states(grid, tokens, low, width, blank=0):
    ladder = [blank] + [x for t in tokens for x in (t, blank)]
    within = lambda t, s: low[t] <= s < low[t] + width
    best = [grid[0][ladder[s]] if s < 2 and within(0, s) else -np.inf for s in range(len(ladder))]
    came = []
    for t in range(1, len(grid)):
        row, new = [], []
        for s in range(len(ladder)):
            options = [best[s], best[s - 1] if s else -np.inf, best[s - 2] if s > 1 and ladder[s] != ladder[s - 2] else -np.inf]
            row.append(max(range(3), key=lambda k: options[k]))
            new.append(max(options) + grid[t][ladder[s]] if within(t, s) else -np.inf)
        came.append(row)
        best = new
    s = len(ladder) - 1 - int(best[-1] < best[-2])
    if not np.isfinite(best[s]):
        return None
    path = [s]
    for row in reversed(came):
        path.append(path[-1] - row[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("ties", [False, True])
def test_best_states_are_those_of_the_plain_trellis(ties):
    rng = np.random.default_rng(7)
    refused = 0
    for _ in range(200):
        tokens, frames = rng.integers(1, 5, rng.integers(1, 12)), int(rng.integers(1, 40))
        grid = rng.integers(-3, 1, (frames, 5)).astype(float) if ties else rng.normal(size=(frames, 5))
        states = 2 * len(tokens) + 1
        width = int(rng.integers(2, states + 1))
        low = np.minimum(np.maximum.accumulate(np.linspace(0, states - width, frames) + rng.integers(-2, 3, frames)).clip(0).astype(int), states - width)
        want, found = plain_states(grid, tokens, low, width), trellis.best_states(grid, tokens, low, width, 0)
        refused += want is None
        assert (None if found is None else found.tolist()) == want
    assert 0 < refused < 200


def test_more_frames_than_a_block_of_moves():
    rng = np.random.default_rng(8)
    tokens = rng.integers(1, 5, 150)
    grid = rng.normal(size=(2 * trellis.BLOCK + 33, 5))
    low = np.zeros(len(grid), int)
    assert trellis.best_states(grid, tokens, low, 301, 0).tolist() == plain_states(grid, tokens, low, 301)


def test_sure_paths_are_the_best_ones_and_ties_are_not_sure():
    rng = np.random.default_rng(9)
    sure = 0
    for _ in range(300):
        label = rng.integers(0, 3, rng.integers(1, 9))
        tokens = np.array([x for k, x in enumerate(label) if x and (not k or label[k - 1] != x)], int)
        grid = rng.normal(size=(len(label), 3))
        grid[np.arange(len(label)), label] += 2
        found = trellis.sure_states(grid, tokens, 0) if len(tokens) else None
        if found is not None:
            sure += 1
            assert found.tolist() == trellis.best_states(grid, tokens, np.zeros(len(grid), int), 2 * len(tokens) + 1, 0).tolist()
    assert sure > 50
    assert trellis.sure_states(np.array([[0.0, 0.0], [-1.0, 0.0]]), np.array([1]), 0) is None
    assert trellis.sure_states(np.array([[-1.0, np.nan]]), np.array([1]), 0) is None


def test_a_text_that_is_heard_as_written_takes_no_trellis(monkeypatch):
    """2,000 letters in 6,000 frames took a row of 4,001 states a frame."""
    tokens = np.random.default_rng(1).integers(1, 27, 2000)
    grid = np.full((6000, 27), -12.0)
    label = np.zeros(6000, int)
    label[1::3] = tokens
    grid[np.arange(6000), label] = 0.0
    monkeypatch.setattr(folds, "best_states", lambda *_: pytest.fail("a trellis was filled"))
    first, last, score = folds.aligned(grid, tokens)
    assert (first == last).all() and first.tolist() == list(range(1, 6000, 3)) and (score == 0).all()


def test_grids_of_segments_are_neither_sent_nor_sorted(spark):
    """Each segment's frames stay where they are made: only texts are exchanged, and no more than twice."""
    for name in ("ctc_place", "ctc_place_all", "read_back", "read_back_all"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        after = plan[: plan.index("RepartitionByExpression")]
        assert "logp" in after or "tokens" in after
        assert "Window" not in after and "Aggregate" not in after and "Sort" not in after and "CoGroup" not in after


class Counted(np.ndarray):
    """A grid that counts the scores that are looked up in it."""

    looked = 0

    def take(self, indices, axis=None, **how):
        Counted.looked += len(self) * len(indices)
        return np.asarray(self).take(indices, axis=axis, **how)


def heard_as(letters, kinds, rng):
    label = np.zeros(3 * len(letters), int)
    label[1::3] = letters
    grid = -12.0 - rng.integers(0, 13, (len(label), kinds)) / 16
    grid[np.arange(len(label)), label] += 12
    return grid


def looked_up(grid, tokens):
    """How many states a frame are filled, and whether they hold the best path."""
    Counted.looked = 0
    found = trellis.best_states(grid.view(Counted), tokens, np.zeros(len(grid), int), 2 * len(tokens) + 1, 0)
    assert found.tolist() == plain_states(grid.tolist(), tokens.tolist(), [0] * len(grid), 2 * len(tokens) + 1)
    return Counted.looked / len(grid)


def test_a_text_between_others_is_sought_near_its_letters():
    """Letters of other segments to either side, as in the window around a segment: every frame took all 601 states."""
    rng = np.random.default_rng(10)
    tokens = rng.integers(1, 7, 300)
    grid = heard_as(np.concatenate([rng.integers(7, 13, 40), tokens, rng.integers(7, 13, 20)]), 13, rng)
    assert looked_up(grid, tokens) < 400


def test_a_line_that_is_written_twice_is_sought_near_it():
    """All 1,041 states were filled for each frame to the end; after the line nothing is in doubt."""
    rng = np.random.default_rng(11)
    before, line, after = rng.integers(1, 27, 100), rng.integers(1, 27, 40), rng.integers(1, 27, 340)
    grid = heard_as(np.concatenate([before, line, after]), 27, rng)
    assert looked_up(grid, np.concatenate([before, line, line, after])) < 250


def test_heard_beside_the_text_and_scores_without_bounds():
    """Runs that no token has, labels as likely, and scores of minus infinity bear on no path."""
    rng = np.random.default_rng(12)
    for k in range(60):
        tokens = rng.integers(1, 4, 30)
        heard = [np.concatenate([tokens, rng.integers(1, 4, 90)]), np.delete(tokens, slice(5, 12)), np.repeat(tokens, 1 + (np.arange(30) % 7 == 0))][k % 3]
        grid = heard_as(heard, 4, rng) + (rng.integers(-2, 3, (3 * len(heard), 4)) if k % 2 else 0)
        if k % 5 == 0:
            grid[rng.random(grid.shape) < 0.03] = -np.inf
        states = 61
        width = states if k % 4 else 31
        low = np.linspace(0, states - width, len(grid)).astype(int)
        want, found = plain_states(grid.tolist(), tokens.tolist(), low, width), trellis.best_states(grid, tokens, low, width, 0)
        assert (None if found is None else found.tolist()) == want
