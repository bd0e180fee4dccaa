"""The damage model: rates, likelihoods, gradients and covariances, in numpy on the 30-row profile.

Parameters x = (lambda, delta, delta_s, nu). The overhangs of a molecule have weights c_0 = 1 + lambda and
c_k = lambda (1 - lambda)^k; with l + r <= 15, position n (from an end) of a molecule of length L is behind a nick with

    p1_left  = 1/4 sum c_l c_r (n - l) nu / (1 + (L - 2 - l - r) nu)          l <= n, r <= L - n - 1
    p1_right = 1/4 sum c_l c_r (L - n - 1 - l) nu / (1 + (L - 2 - l - r) nu)  r <= n, l <= L - n - 1

and in the single-stranded overhang with p4 = (1 - lambda)^(n + 1) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..schema import LENGTH_LIMIT, MIN_LENGTH, POSITIONS

_K = np.arange(POSITIONS + 1)
_l, _r = np.meshgrid(_K, _K, indexing="ij")
_pair = _l + _r <= POSITIONS


@dataclass(frozen=True)
class Profile:
    """freq_ct[idx], ... of operators.profile as arrays of 30, and a length distribution."""

    freq_ct: np.ndarray
    freq_ga: np.ndarray
    scale_ct: np.ndarray
    scale_ga: np.ndarray
    seq_err: np.ndarray
    max_all: float
    lengths: np.ndarray
    freqs: np.ndarray

    @classmethod
    def of(cls, rows, lengths, freqs) -> Profile:
        """rows: of operators.profile.profile; a null ratio is a position without such bases and weighs nothing."""
        rows = sorted(rows, key=lambda r: r["idx"])
        if [r["idx"] for r in rows] != list(range(2 * POSITIONS)):
            raise ValueError("a profile has one row for each of 30 positions")
        get = lambda c: np.array([0.0 if r[c] is None else r[c] for r in rows], float)
        return cls(*(get(c) for c in ("freq_ct", "freq_ga", "scale_ct", "scale_ga", "seq_err")), float(rows[0]["max_all"]), np.asarray(lengths, float), np.asarray(freqs, float))


def _overhangs(lam: float) -> list[np.ndarray]:
    """The weights c_l c_r over [l, r] with l + r <= 15, and their first and second derivatives by lambda."""
    low = lambda k: (1 - lam) ** np.maximum(_K - k, 0)
    c = np.where(_K == 0, 1 + lam, lam * low(0))
    c1 = np.where(_K == 0, 1.0, low(0) - _K * lam * low(1))
    c2 = np.where(_K == 0, 0.0, -2 * _K * low(1) + _K * (_K - 1) * lam * low(2))
    both = lambda a, b: a[:, None] * b[None, :] * _pair
    return [both(c, c), both(c1, c) + both(c, c1), both(c2, c) + 2 * both(c1, c1) + both(c, c2)]


#: Orders of derivatives by (lambda, nu) in what _behind_nick gives.
_ORDERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))


def _nick(nu: float, a: np.ndarray) -> list[np.ndarray]:
    """nu / (1 + a nu) and its first and second derivatives by nu."""
    rest = 1 + a * nu
    return [nu / rest, 1 / rest**2, -2 * a / rest**3]


def _behind_nick(lam: float, nu: float, length: np.ndarray, n: np.ndarray, order: int = 1):
    """p1_left and p1_right, each a list by _ORDERS up to ``order`` of [n, length]."""
    w = _overhangs(lam)
    orders = [o for o in _ORDERS if sum(o) <= order]
    if length.min(initial=np.inf) >= 2 * POSITIONS and n.max() < POSITIONS:
        return _behind_nick_long([x.ravel() for x in w], nu, length, n, orders)
    L, m = length[None, :, None, None], n[:, None, None, None]
    g = _nick(nu, L - 2 - _l - _r)
    out = []
    for count, ok in (((m - _l), (_l <= m) & (_r <= L - m - 1)), ((L - m - 1 - _l), (_r <= m) & (_l <= L - m - 1))):
        a = np.where(ok, count, 0.0)
        out.append([(w[i][None, None] * a * g[j]).sum((2, 3)) / 4 for i, j in orders])
    return out


_sum_of = ((_l + _r).ravel()[:, None] == np.arange(2 * POSITIONS + 1)[None, :]).astype(float)


def _behind_nick_long(w: list[np.ndarray], nu: float, length: np.ndarray, n: np.ndarray, orders):
    """_behind_nick where no overhang reaches the other end: the weights depend on n and l + r alone, so what is summed
    for each length has one term for each l + r."""
    l, r, m = _l.ravel()[None, :], _r.ravel()[None, :], n[:, None]
    left, right, right_l = np.where(l <= m, m - l, 0.0), (r <= m).astype(float), np.where(r <= m, l, 0.0)
    both = np.arange(2 * POSITIONS + 1)[:, None]  # l + r
    g = [np.where(both <= POSITIONS, x, 0.0) for x in _nick(nu, length[None, :] - 2 - both)]
    far = length[None, :] - m - 1
    out: list = [[], []]
    for i, j in orders:
        out[0].append((left * w[i]) @ _sum_of @ g[j] / 4)
        out[1].append((far * ((right * w[i]) @ _sum_of @ g[j]) - (right_l * w[i]) @ _sum_of @ g[j]) / 4)
    return out


def rate_derivatives(x, model: str, length: np.ndarray, n: np.ndarray = np.arange(POSITIONS), order: int = 2) -> list[np.ndarray]:
    """The rates [signal, n, length] and, up to ``order``, their first derivatives [parameter, ...] and second ones
    [parameter, parameter, ...]."""
    lam, d, ds, nu = x
    length = np.asarray(length, float)
    pl, pr = _behind_nick(lam, nu, length, n, order)
    one, m = np.ones_like(pl[0]), n[:, None]
    p4 = [
        one * v
        for v in ((1 - lam) ** (m + 1) / 2, -(m + 1) * (1 - lam) ** m / 2, 0.0, (m + 1) * m * (1 - lam) ** np.maximum(m - 1, 0) / 2, 0.0, 0.0)[: len(pl)]
    ]
    zero = [np.zeros_like(one)] * len(pl)
    # double-strand and single-strand weights of each signal with their derivatives by lambda and nu
    left, right = ([(k == 0) - a - b for k, (a, b) in enumerate(zip(p4, p, strict=True))] for p in (pl, pr))
    if model == "b":
        double = [left, pr, right, pl]
    else:
        first, second = ([(a + b) / 2 for a, b in zip(*y, strict=True)] for y in ((pr, left), (pl, right)))
        double = [first, first, second, second]
    a, b = (np.moveaxis(np.array(v), 1, 0) for v in (double, [p4, p4, zero, zero]))
    out = [a[0] * d + b[0] * ds]
    if order > 0:
        out.append(np.stack([a[1] * d + b[1] * ds, a[0], b[0], a[2] * d]))
    if order > 1:
        h = np.zeros((4, 4, *a[0].shape))
        for i, j, v in ((0, 0, a[3] * d + b[3] * ds), (0, 1, a[1]), (0, 2, b[1]), (0, 3, a[4] * d), (1, 3, a[2]), (3, 3, a[5] * d)):
            h[i, j] = h[j, i] = v
        out.append(h)
    return out


def rates(x, model: str, length: np.ndarray, n: np.ndarray = np.arange(POSITIONS), grad: bool = False):
    """C-to-T and G-to-A rates [signal, n, length]: CT at 5', GA at 3', CT at 3', GA at 5'. With grad: also their
    derivatives [parameter, signal, n, length]."""
    got = rate_derivatives(x, model, length, n, int(grad))
    return tuple(got) if grad else got[0]


def rate_cube(x, model: str, limit: int = LENGTH_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """C-to-T and G-to-A rates [length - MIN_LENGTH, idx] at all 30 positions."""
    ct5, ga3, ct3, ga5 = rates(x, model, np.arange(MIN_LENGTH, limit))
    return np.concatenate([ct5, ct3[::-1]]).T, np.concatenate([ga3, ga5[::-1]]).T


def _cells(f: np.ndarray, p: Profile):
    """Of each signal and position: the probabilities of a change and of none at the rates f, their slope by f, weights."""
    n, far = np.arange(POSITIONS), 2 * POSITIONS - 1 - np.arange(POSITIONS)
    err = np.stack([p.seq_err[n], p.seq_err[far], p.seq_err[far], p.seq_err[n]])
    scale = np.stack([p.scale_ct[n], p.scale_ga[n], p.scale_ct[far], p.scale_ga[far]])
    freq = np.stack([p.freq_ct[n], p.freq_ga[n], p.freq_ct[far], p.freq_ga[far]])
    slope = 1 - 4 * err / 3
    for prob, k, weight in ((f * (1 - err) + (1 - f) * err / 3, slope, scale * freq), ((1 - f) * (1 - err) + f * err / 3, -slope, scale * (1 - freq))):
        ok = prob > 0
        yield np.where(ok, prob, 1.0), k, np.where(ok, weight, 0.0)


def loss(x, p: Profile, model: str, eps: float = 0.0) -> tuple[float, np.ndarray]:
    """Negative scaled log-likelihood and its gradient."""
    value, slope = rates(x, model, p.lengths, grad=True)
    f, df = (1 - eps) * value @ p.freqs, (1 - eps) * slope @ p.freqs
    total, g = 0.0, np.zeros(4)
    for q, k, weight in _cells(f, p):
        total -= (weight * np.log(q)).sum()
        g -= (df * (weight * k / q)).sum((1, 2))
    return float(total), g


def loss_hessian(x, p: Profile, model: str, eps: float = 0.0) -> np.ndarray:
    """Second derivatives of the loss, exactly."""
    f, df, hf = ((1 - eps) * v @ p.freqs for v in rate_derivatives(x, model, p.lengths))
    h = np.zeros((4, 4))
    for q, k, weight in _cells(f, p):
        h -= (hf * (weight * k / q)).sum((2, 3)) - np.einsum("isn,jsn,sn->ij", df, df, weight * (k / q) ** 2)
    return h


def naive_loss(x, p: Profile) -> tuple[float, np.ndarray]:
    """Without nicks and errors, from the primary signals: parameters lambda, delta, delta_s."""
    lam, d, ds = x
    i = np.arange(POSITIONS)
    s, s_lam = (1 - lam) ** (i + 1) / 2, -(i + 1) * (1 - lam) ** i / 2
    total, g = 0.0, np.zeros(3)
    for freq, scale, prob, slope in (
        (p.freq_ct[i], p.scale_ct[i], d + s * (ds - d), (s_lam * (ds - d), 1 - s, s)),
        (p.freq_ga[i], p.scale_ga[i], s * ds, (s_lam * ds, 0 * s, s)),
    ):
        q = np.clip(prob, 1e-300, 1 - 1e-16)
        total -= (scale * (freq * np.log(q) + (1 - freq) * np.log1p(-q))).sum()
        back = scale * (freq / q - (1 - freq) / (1 - q))
        g -= np.array([(back * k).sum() for k in slope])
    return float(total), g
