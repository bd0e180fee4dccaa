"""Minimisation in a box by limited-memory quasi-Newton steps, for a handful of parameters.

A step goes to the first minimum of the quadratic model along the projected gradient path (the generalised Cauchy point),
from there to the model's minimum over the variables that are not at a bound, and along this direction to a point with
enough decrease and enough less slope (strong Wolfe conditions). The model is rebuilt from the last few pairs of moves and
gradient changes, in the compact form of the BFGS matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PGTOL, FACTOR = 1e-3, 1e6 * np.finfo(float).eps
#: Pairs kept; decrease and slope that a line search asks for; its evaluations at most.
MEMORY, DECREASE, CURVATURE, TRIES = 6, 1e-4, 0.9, 20


@dataclass(frozen=True)
class Minimum:
    x: np.ndarray
    value: float
    calls: int
    at_bound: np.ndarray


def numeric_gradient(fun, x, low, high) -> np.ndarray:
    """Central differences, one-sided at a bound."""
    out = np.zeros(len(x))
    for i in range(len(x)):
        h = (1e-8 * (abs(x[i]) + 1)) ** 0.67
        a, b = x.copy(), x.copy()
        a[i], b[i] = max(low[i], x[i] - h), min(high[i], x[i] + h)
        out[i] = (fun(b) - fun(a)) / (b[i] - a[i])
    return out


class Model:
    """The matrix of the quadratic model: theta I - W M W' of the pairs kept."""

    def __init__(self, n: int, memory: int = MEMORY):
        self.n, self.memory, self.moves, self.changes = n, memory, [], []

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        """A pair without positive curvature is left out: the matrix stays positive definite."""
        if s @ y > np.finfo(float).eps * (y @ y):
            self.moves, self.changes = [*self.moves, s][-self.memory :], [*self.changes, y][-self.memory :]

    def forget(self) -> None:
        self.moves, self.changes = [], []

    def matrix(self) -> np.ndarray:
        if not self.moves:
            return np.eye(self.n)
        s, y = np.array(self.moves).T, np.array(self.changes).T
        theta = (y[:, -1] @ y[:, -1]) / (s[:, -1] @ y[:, -1])
        sy = s.T @ y
        middle = np.block([[-np.diag(np.diag(sy)), np.tril(sy, -1).T], [np.tril(sy, -1), theta * s.T @ s]])
        w = np.hstack([y, theta * s])
        return theta * np.eye(self.n) - w @ np.linalg.solve(middle, w.T)


def cauchy_point(x, g, b, low, high) -> np.ndarray:
    """The first minimum of the model along x - t g, bent at the bounds."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = np.where(g > 0, (x - low) / g, np.where(g < 0, (x - high) / g, np.inf))
    d = np.where(ends > 0, -g, 0.0)
    z, t = np.zeros(len(x)), 0.0
    for end in [*np.unique(ends[ends > 0]), np.inf]:
        slope, bend = g @ d + z @ b @ d, d @ b @ d
        if slope >= 0 or bend <= 0:
            break
        step = -slope / bend
        if t + step < end:
            z = z + step * d
            break
        z = z + (end - t) * d
        t = end
        d = np.where(ends <= end, 0.0, d)
    return np.clip(x + z, low, high)


def subspace_minimum(x, g, b, at, low, high) -> np.ndarray:
    """From the Cauchy point ``at``: the model's minimum over the variables inside their bounds, cut at the first bound."""
    free = (at > low) & (at < high)
    if not free.any():
        return at
    r = (g + b @ (at - x))[free]
    move = -np.linalg.solve(b[np.ix_(free, free)], r)
    a, lo, hi = at[free], low[free], high[free]
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(move > 0, (hi - a) / move, np.where(move < 0, (lo - a) / move, np.inf))
    out = at.copy()
    out[free] = np.clip(a + min(1.0, room.min()) * move, lo, hi)
    return out


def _between(a, fa, ga, b, fb, gb) -> float:
    """A place between a and b: the minimum of the cubic through both, kept off the ends."""
    c = ga + gb - 3 * (fa - fb) / (a - b)
    root = c * c - ga * gb
    low, high = min(a, b), max(a, b)
    t = (a + b) / 2
    if np.isfinite(root) and root >= 0:
        e = np.sign(b - a) * np.sqrt(root)
        rest = gb - ga + 2 * e
        if rest:
            t = b - (b - a) * (gb + e - c) / rest
    return float(np.clip(t, low + 0.1 * (high - low), high - 0.1 * (high - low))) if np.isfinite(t) else (a + b) / 2


def line_search(at, value: float, slope: float, most: float, first: float = 1.0):
    """(t, value, gradient, evaluations) with decrease and curvature, t up to ``most``; at(t) gives value, gradient and
    slope. None for t if there is none."""
    before, hold, t, calls = (0.0, value, slope), None, min(first, most), 0
    for _ in range(TRIES):  # until an interval holds such a place
        v, g, s = at(t)
        calls += 1
        enough = np.isfinite(v) and v <= value + DECREASE * t * slope
        if not enough or (calls > 1 and v >= before[1]):
            hold = (before, (t, v if np.isfinite(v) else np.inf, s))
            break
        if abs(s) <= -CURVATURE * slope or (t >= most and s < 0):
            return t, v, g, calls
        if s >= 0:
            hold = ((t, v, s), before)
            break
        before, t = (t, v, s), min(4 * t, most)
    if hold is None:
        return None, value, None, calls
    low, high = hold  # low: the lower value of the two with enough decrease
    best = None
    while calls < TRIES and abs(high[0] - low[0]) > 1e-12 * max(abs(high[0]), 1e-12):
        t = _between(*low, *high) if np.isfinite(high[1]) else (low[0] + high[0]) / 2
        v, g, s = at(t)
        calls += 1
        if not np.isfinite(v) or v > value + DECREASE * t * slope or v >= low[1]:
            high = (t, v if np.isfinite(v) else np.inf, s)
            continue
        best = (t, v, g)
        if abs(s) <= -CURVATURE * slope:
            break
        if s * (high[0] - low[0]) >= 0:
            high = low
        low = (t, v, s)
    return (*best, calls) if best else (None, value, None, calls)


def minimise(fun, x, low, high, pgtol: float = PGTOL, factor: float = FACTOR, steps: int = 500) -> Minimum:
    """fun gives value and gradient. Ends when the projected gradient or the decrease is small."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x, float), low, high)
    value, g = fun(x)
    calls, model = 1, Model(len(x))
    for _ in range(steps):
        if np.abs(np.clip(x - g, low, high) - x).max() <= pgtol:
            break
        b = model.matrix()
        d = subspace_minimum(x, g, b, cauchy_point(x, g, b, low, high), low, high) - x
        t = None
        if g @ d < 0:
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(d > 0, (high - x) / d, np.where(d < 0, (low - x) / d, np.inf))

            def at(t, x=x, d=d):
                v, gt = fun(np.clip(x + t * d, low, high))
                return v, gt, gt @ d

            most = max(1.0, min(float(room.min()), 1e3))
            # the first step of a new model has no scale
            first = 1.0 if model.moves else min(1.0, 1 / max(np.linalg.norm(d), 1e-300))
            t, v, gt, used = line_search(at, value, float(g @ d), most, first)
            calls += used
        if t is None:
            if not model.moves:
                break
            model.forget()
            continue
        y = np.clip(x + t * d, low, high)
        model.learn(y - x, gt - g)
        small = value - v <= factor * max(abs(value), abs(v), 1.0)
        x, value, g = y, v, gt
        if small:
            break
    return Minimum(x, float(value), calls, (x <= low) | (x >= high))


def newton_polish(f, hessian, x, low, high, steps: int = 6) -> tuple[np.ndarray, float, int]:
    """(x, value, evaluations of f) from a place near a minimum: Newton steps in the box, as long as they don't make f larger.
    What a first-order method leaves of the gradient goes."""
    value, g = f(x)
    calls = 1
    for _ in range(steps):
        new = _newton_in_box(x, g, hessian(x), low, high)
        v, slope = f(new)
        calls += 1
        if not np.isfinite(v) or v > value + 1e-13 * abs(value):
            break
        done = np.abs(new - x).max() < 1e-11
        x, value, g = new, v, slope
        if done:
            break
    return x, value, calls


def _newton_in_box(x, g, h, low, high) -> np.ndarray:
    """x after a Newton step. Parameters that the step would take over a bound stop there, and the others follow."""
    move = np.zeros(len(x))
    free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
    while free.any():
        try:
            move[free] = -np.linalg.solve(h[np.ix_(free, free)], g[free] + h[np.ix_(free, ~free)] @ move[~free])
        except np.linalg.LinAlgError:
            return x
        over = free & ((x + move < low) | (x + move > high))
        if not over.any():
            break
        move[over] = np.clip(x + move, low, high)[over] - x[over]
        free &= ~over
    return np.clip(x + move, low, high)
