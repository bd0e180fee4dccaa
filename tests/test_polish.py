"""Newton steps in a box, against minima that are known."""

import numpy as np
import pytest

from paleoframe.plans.optimize import newton_polish


def bowl(h, at):
    return lambda x: (float((x - at) @ h @ (x - at) / 2), h @ (x - at))


def test_inside_and_at_a_bound():
    h = np.array([[2.0, 0.9, 0], [0.9, 1.0, 0.3], [0, 0.3, 4.0]])
    low, high = np.zeros(3), np.ones(3)
    x, value, _ = newton_polish(bowl(h, np.array([0.5, 0.4, 0.2])), lambda x: h, np.array([0.4, 0.5, 0.3]), low, high)
    assert x == pytest.approx([0.5, 0.4, 0.2], abs=1e-12) and value == pytest.approx(0, abs=1e-20)
    # the minimum lies over a bound: the others move to where they are best beside it
    at = np.array([0.5, 1.2, 0.2])
    x, value, _ = newton_polish(bowl(h, at), lambda x: h, np.array([0.6, 0.9999, 0.3]), low, high)
    rest = np.linalg.solve(h[np.ix_([0, 2], [0, 2])], -h[[0, 2], 1] * (1 - at[1]))
    assert x == pytest.approx([at[0] + rest[0], 1, at[2] + rest[1]], abs=1e-12)


def test_no_step_uphill_or_without_a_solution():
    zero = np.zeros((2, 2))
    x, _, calls = newton_polish(lambda x: (float(-(x**2).sum()), -2 * x), lambda x: zero, np.array([0.3, 0.4]), np.zeros(2), np.ones(2))
    assert list(x) == [0.3, 0.4] and calls == 2
