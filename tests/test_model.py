import math

import numpy as np
import pytest

from paleoframe.operators.lengths import rebin
from paleoframe.plans import mixture as M
from paleoframe.plans import model as DM
from paleoframe.plans.fit import fit_profile
from paleoframe.plans.model import Profile, loss, naive_loss, rate_cube, rates
from paleoframe.plans.optimize import minimise, numeric_gradient

X = np.array([0.36, 0.01, 0.7, 0.02])


def plain_rates(x, model, L, n):
    lam, d, ds, nu = x
    c = lambda k: 1 + lam if k == 0 else lam * (1 - lam) ** k
    pl = pr = 0.0
    for a in range(16):
        for b in range(16 - a):
            f = c(a) * c(b) * nu / (1 + (L - 2 - a - b) * nu) / 4
            pl += f * (n - a) if a <= n and b <= L - n - 1 else 0
            pr += f * (L - n - 1 - a) if b <= n and a <= L - n - 1 else 0
    s = (1 - lam) ** (n + 1) / 2
    if model == "b":
        return (1 - s - pl) * d + s * ds, pr * d + s * ds, (1 - s - pr) * d, pl * d
    one, two = (pr + 1 - s - pl) / 2 * d + s * ds, (pl + 1 - s - pr) / 2 * d
    return one, one, two, two


def profile(x, model, err=0.002, lengths=(40, 70, 120), freqs=(0.3, 0.5, 0.2)):
    """What infinitely many reads of the model show."""
    f = rates(x, model, np.array(lengths)) @ np.array(freqs)
    seen = f * (1 - err) + (1 - f) * err / 3
    ct, ga = np.concatenate([seen[0], seen[2][::-1]]), np.concatenate([seen[1], seen[3][::-1]])
    one = np.ones(30)
    return Profile(ct, ga, one, one, one * err, 1e4, np.array(lengths, float), np.array(freqs))


@pytest.mark.parametrize("model", ["b", "nb"])
def test_rates(model):
    lengths = np.array([30, 31, 44, 149])
    got = rates(X, model, lengths)
    for j, L in enumerate(lengths):
        for n in range(15):
            assert got[:, n, j] == pytest.approx(plain_rates(X, model, L, n), rel=1e-12)
    ct, ga = rate_cube(X, model)
    assert ct.shape == (120, 30)
    assert (ct[0, 3], ct[0, 29 - 3], ga[0, 29 - 3]) == pytest.approx((got[0, 3, 0], got[2, 3, 0], got[3, 3, 0]))


@pytest.mark.parametrize("model", ["b", "nb"])
def test_gradients(model):
    p = profile(X, model)
    x = np.array([0.3, 0.02, 0.6, 0.05])
    slow = numeric_gradient(lambda y: loss(y, p, model, 0.1)[0], x, np.zeros(4), np.ones(4))
    assert loss(x, p, model, 0.1)[1] == pytest.approx(slow, rel=1e-4, abs=1e-6)
    slow = numeric_gradient(lambda y: naive_loss(y, p)[0], x[:3], np.zeros(3), np.ones(3))
    assert naive_loss(x[:3], p)[1] == pytest.approx(slow, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("model", ["b", "nb"])
def test_parameters_are_recovered(model):
    got = fit_profile(profile(X, model), model)
    assert got.x[:3] == pytest.approx(X[:3], abs=0.02)
    assert np.all(got.low <= got.high)


def test_minimise_in_a_box():
    f = lambda x: (float(((x - [2, -1]) ** 2).sum()), 2 * (x - np.array([2, -1])))
    m = minimise(f, (0.5, 0.5), (0, 0), (1, 1), pgtol=1e-8)
    assert m.x == pytest.approx([1, 0]) and m.at_bound.all()


def test_length_probability():
    p = M.length_probability(60, 20)
    assert p.shape == (3, 120) and p[0].sum() == pytest.approx(1)
    h = 1e-5
    assert p[1] == pytest.approx((M.length_probability(60 + h, 20)[0] - M.length_probability(60 - h, 20)[0]) / (2 * h), abs=1e-8)
    assert p[2] == pytest.approx((M.length_probability(60, 20 + h)[0] - M.length_probability(60, 20 - h)[0]) / (2 * h), abs=1e-8)


def test_mixture_evaluation_and_fit(spark):
    rng = np.random.default_rng(5)
    n, eps, want = 4000, 0.4, (55.0, 16.0, 110.0, 20.0)
    anc = rng.random(n) > eps
    lens = np.where(anc, rng.normal(*want[:2], n), rng.normal(*want[2:], n)).round()
    keep = (lens >= 30) & (lens < 150)
    rows = [(1.0, float(np.exp(2 if a else -2)), int(x)) for a, x, k in zip(anc, lens, keep, strict=True) if k]
    df = spark.createDataFrame(rows, "l_err double, l_anc double, length int").cache()
    x = np.array([60.0, 20.0, 100.0, 30.0])
    value, grad = M.evaluate(df, x, eps)
    a, m = M.length_probability(*x[:2])[0], M.length_probability(*x[2:])[0]
    plain = -sum(math.log(la * a[k - 30] * (1 - eps) + le * m[k - 30] * eps) for le, la, k in rows)
    assert value == pytest.approx(plain)
    slow = numeric_gradient(lambda y: M.evaluate(df, y, eps)[0], x, x - 1, x + 1)
    assert grad == pytest.approx(slow, rel=1e-3, abs=1e-2)
    h = M.hessian(df, x, eps)
    step = np.array([1e-3, 0, 0, 0])
    assert h[0] == pytest.approx((M.evaluate(df, x + step, eps)[1] - M.evaluate(df, x - step, eps)[1]) / 2e-3, rel=1e-2, abs=1e-3)
    assert M.fit_mixture(df, eps).x == pytest.approx(want, rel=0.12)


def test_rebin():
    lens, f = [30, 31, 32, 33], [0.1, 0.2, 0.3, 0.4]
    assert rebin(lens, f) == (lens, f)
    assert rebin(lens, f, 2) == ([30.5, 32.5], pytest.approx([0.3, 0.7]))
    assert sum(rebin(lens, f, 3)[1]) == pytest.approx(1)


@pytest.mark.parametrize("mu, sigma, low, limit", [(60.0, 20.0, 30, 150), (31.0, 1.0, 30, 150), (149.0, 100.0, 35, 150), (30.0, 1.5, 40, 512), (80.0, 7.0, 30, 512)])
def test_derivatives_of_length_probabilities(mu, sigma, low, limit):
    """Against differences in 50 decimal digits, where the normal distribution is a series."""
    from decimal import Decimal, getcontext

    getcontext().prec = 90
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534211706798")

    def cdf(z):
        # erf by its series of positive terms, as long as they count; beyond 14 standard deviations nothing is left
        if abs(z) > 14:
            return Decimal(int(z > 0))
        term = total = z
        k = 0
        while abs(term) > Decimal(10) ** -75:
            k += 1
            term = term * z * z / (2 * k + 1)
            total += term
        return Decimal("0.5") + total * (-z * z / 2).exp() / (2 * pi).sqrt()

    def shares(m, s):
        edge = [cdf((Decimal(k) - Decimal("0.5") - m) / s) for k in range(low, limit + 1)]
        return [(b - a) / (edge[-1] - edge[0]) for a, b in zip(edge, edge[1:], strict=False)]

    m, s, h = Decimal(mu), Decimal(sigma), Decimal(10) ** -15
    f = {(i, j): shares(m + i * h, s + j * h) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    pairs = lambda g: [float(g(k)) for k in range(limit - low)]
    want = [
        pairs(lambda k: f[0, 0][k]), pairs(lambda k: (f[1, 0][k] - f[-1, 0][k]) / (2 * h)), pairs(lambda k: (f[0, 1][k] - f[0, -1][k]) / (2 * h)),
        pairs(lambda k: (f[1, 0][k] - 2 * f[0, 0][k] + f[-1, 0][k]) / (h * h)), pairs(lambda k: (f[0, 1][k] - 2 * f[0, 0][k] + f[0, -1][k]) / (h * h)),
        pairs(lambda k: (f[1, 1][k] - f[1, -1][k] - f[-1, 1][k] + f[-1, -1][k]) / (4 * h * h)),
    ]
    got = M.length_derivatives(mu, sigma, low, limit)
    assert np.isfinite(got).all()
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-10 * max(1.0, np.abs(b).max()))


def test_points_of_a_batch(spark):
    rng = np.random.default_rng(12)
    n = 400
    rows = list(zip((rng.random(n) * 1e-3).tolist(), rng.random(n).tolist(), rng.integers(25, 160, n).tolist(), strict=True))
    df = spark.createDataFrame(rows + [(0.0, 0.0, 70)], "l_err double, l_anc double, length int").cache()
    points, eps = [(60.0, 20.0, 110.0, 30.0), (90.0, 15.0, 30.0, 100.0), (149.0, 50.0, 70.0, 1.0)], 0.1

    def value(x):
        a, m = M.length_probability(x[0], x[1])[0], M.length_probability(x[2], x[3])[0]
        at = [min(max(r[2], 30), 149) - 30 for r in rows]
        return -sum(np.log(max(r[1] * (1 - eps) * a[k] + r[0] * eps * m[k], 1e-300)) for r, k in zip(rows, at, strict=True)) - np.log(1e-300)

    for x, p in zip(points, M.evaluate_points(df, points, eps), strict=True):
        assert p.value == pytest.approx(value(x), rel=1e-12)
        assert np.allclose(p.hessian, p.hessian.T)
        for i in range(4):
            if 15 < x[i] < 149:
                e = np.zeros(4)
                e[i] = 1e-4
                up, down = M.evaluate_points(df, [np.add(x, e), np.subtract(x, e)], eps)
                assert p.gradient[i] == pytest.approx((value(np.add(x, e)) - value(np.subtract(x, e))) / 2e-4, rel=1e-5, abs=1e-4)
                assert np.allclose(p.hessian[i], (up.gradient - down.gradient) / 2e-4, rtol=1e-5, atol=1e-5)


def test_the_fit_of_the_mixture_is_an_optimum_in_few_jobs(spark):
    rng = np.random.default_rng(13)
    old = rng.random(3000) < 0.7
    lens = np.clip(np.where(old, rng.normal(55, 18, 3000), rng.normal(115, 20, 3000)).round(), 30, 149).astype(int)
    rows = [(1e-3, 0.5, int(k)) if o else (0.5, 1e-3, int(k)) for o, k in zip(old, lens, strict=True)]
    df = spark.createDataFrame(rows, "l_err double, l_anc double, length int").cache()
    got = M.fit_mixture(df, 0.3)
    assert got.jobs <= 15 and got.calls <= 5 * got.jobs
    near = [np.clip(got.x + np.array(d) * s, M.LOW, M.HIGH) for s in (0.05, 1.0, 10.0) for d in ((1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0), (0, 0, 1, 0), (0, 0, -1, 0), (0, 0, 0, 1), (0, 0, 0, -1), (1, 1, 1, 1), (1, -1, -1, 1))]
    assert min(p.value for p in M.evaluate_points(df, near, 0.3)) >= -got.llh - 1e-6
    inside = (got.x > M.LOW) & (got.x < M.HIGH)
    assert (got.low[inside] < got.x[inside]).all() and (got.high[inside] > got.x[inside]).all()


@pytest.mark.parametrize("model", ["b", "nb"])
@pytest.mark.parametrize("low", [18, 30])
def test_exact_second_derivatives(model, low):
    """Against differences of the gradient with two steps, extrapolated; also where overhangs reach the other end."""
    p = profile(X, model)
    p = DM.Profile(p.freq_ct, p.freq_ga, p.scale_ct, p.scale_ga, p.seq_err, p.max_all, np.arange(low, low + 40.0), np.full(40, 1 / 40))
    x = np.array((0.3, 0.02, 0.6, 0.03))
    h = DM.loss_hessian(x, p, model, 0.1)
    assert np.allclose(h, h.T, rtol=1e-12)

    def slope(i, s):
        e = np.zeros(4)
        e[i] = s
        return (DM.loss(x + e, p, model, 0.1)[1] - DM.loss(x - e, p, model, 0.1)[1]) / (2 * s)

    for i in range(4):
        s = 2e-4 * x[i] ** 0.5
        want = (4 * slope(i, s / 2) - slope(i, s)) / 3
        assert np.allclose(h[i], want, rtol=1e-7, atol=1e-8 * np.abs(h).max())


@pytest.mark.parametrize("model", ["b", "nb"])
def test_few_calls_and_nothing_better_around(model):
    """A sample like the published one."""
    x = (0.348019, 0.008409, 0.730853, 0.004318)
    p = profile(x, model)
    f = lambda y: DM.loss(y, p, model)
    got = fit_profile(p, model)
    assert got.calls <= 40
    for step in (1e-3, 1e-2, 5e-2):
        for k in range(81):
            y = got.x + step * np.array([k % 3 - 1, k // 3 % 3 - 1, k // 9 % 3 - 1, k // 27 - 1]) * np.maximum(got.x, 1e-3)
            if (y > 0).all() and (y < 1).all():
                assert f(y)[0] >= -got.llh - 1e-6


def test_minimise_hard_functions():
    def rosen(x):
        a, b = x
        return float((1 - a) ** 2 + 100 * (b - a * a) ** 2), np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    m = minimise(rosen, (-1.2, 1.0), (-5, -5), (5, 5), pgtol=1e-9, factor=1e-16)
    assert m.x == pytest.approx([1, 1], abs=1e-5) and m.calls < 80
    m = minimise(rosen, (-1.2, 1.0), (-5, -5), (0.5, 5), pgtol=1e-9, factor=1e-16)
    assert m.x == pytest.approx([0.5, 0.25], abs=1e-6) and list(m.at_bound) == [True, False]
    rng = np.random.default_rng(3)
    for n in (1, 3, 6):
        for _ in range(30):
            a = rng.normal(size=(n, n))
            a, c = a @ a.T + 0.1 * np.eye(n), rng.normal(size=n) * 3
            low, high = -rng.random(n), rng.random(n)
            m = minimise(lambda x, a=a, c=c: (float(x @ a @ x / 2 + c @ x), a @ x + c), rng.uniform(low, high), low, high, pgtol=1e-8, factor=0)
            g = a @ m.x + c
            assert np.abs(np.clip(m.x - g, low, high) - m.x).max() < 1e-6


def test_line_search_meets_its_conditions():
    from paleoframe.plans import optimize as O

    for f, df in ((lambda t: (t - 3) ** 4, lambda t: 4 * (t - 3) ** 3), (lambda t: -t / (t * t + 2), lambda t: (t * t - 2) / (t * t + 2) ** 2), (lambda t: np.cos(5 * t) + t * t / 50, lambda t: -5 * np.sin(5 * t) + t / 25)):
        start = 0.05
        for first in (1e-3, 0.3, 1.0, 8.0):
            at = lambda t, f=f, df=df: (f(start + t), np.array([df(start + t)]), df(start + t))
            t, v, _, calls = O.line_search(at, f(start), df(start), 100.0, first)
            assert calls <= O.TRIES and v <= f(start) + O.DECREASE * t * df(start) and abs(df(start + t)) <= -O.CURVATURE * df(start)
