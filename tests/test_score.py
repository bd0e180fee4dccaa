"""The scoring kernel against plain loops over overhangs, nicks and bases."""

import math

import numpy as np
import pytest

from paleoframe.operators import score as S

HI, LO, TOL = 1 - 1e-8, 1e-8, 1e-8


def factor(ref, read, q, state, d, ds):
    if ref > 3 or read > 3 or q == 255:
        return 1.0
    e = 10 ** (-q / 10)
    rate = {"ssc": ds, "dsc": d, "ssg": ds, "dsg": d}[state] * (1 - 4 * e / 3)
    base, to = (1, 3) if state[2] == "c" else (2, 0)
    if ref == base and read == to:
        return min(e / 3 + rate, HI)
    if ref == base and read == base:
        return max(1 - e - rate, LO)
    return max(1 - e, LO) if ref == read else min(e / 3, HI)


def clean(ref, state, d, ds):
    base = 1 if state[2] == "c" else 2
    return 1 - (ds if state[:2] == "ss" else d) if ref == base else 1.0


def brute(x, L, left, right, damage):
    """left, right: factor of base i of an end in a state."""
    lam, d, ds, nu = x
    q = (1 - lam) ** (L - 1)

    def p(k):
        return 0.5 * lam * (1 - lam) ** k / (1 - q) + (0.5 if k == 0 else 0)

    def dp(a, b):
        return 4 * p(a) * p(b) / (3 + (1 - q - (L - 1) * lam * q) / (1 - q) ** 2)

    def ends(a, b, nick, where):
        out = 1.0
        for i in range(15):
            out *= left(i, "ssc" if i < a else "dsg" if where == "left" and i > nick else "dsc")
            out *= right(i, "ssg" if i < b else "dsc" if where == "right" and i > L - nick - 1 else "dsg")
        return out

    total = seen = 0.0
    pairs = [(a, b) for a in range(16) for b in range(16)]
    pairs += [(a, b) for a in range(16) for b in range(16, L - 1 - a)] + [(a, b) for b in range(16) for a in range(16, L - 1 - b)]
    for a, b in pairs:
        w = dp(a, b)
        seen += w
        if w <= TOL:
            continue
        D, used = 1 + (L - a - b - 2) * nu, 0.0
        places = []
        if a <= 15:
            stop = 14 if b <= 15 else min(14, L - b - 1)
            for n in range(a, stop + 1):
                end = damage and b > 15 and n == L - b - 1
                places.append((n, "left", (1 - nu) / D if end else nu / D))
        if b <= 15:
            begin = (L - 16 if damage else L - 15) if a <= 15 else max(L - 16, a)
            for n in range(begin, L - b):
                places.append((n, "right", (1 - nu) / D if n == L - b - 1 else nu / D))
        for n, where, v in places:
            total += w * v * ends(a, b, n, where)
            used += v
        total += w * (1 - used) * ends(a, b, None, "")
    if 1 - seen > TOL:
        total += (1 - seen) * ends(99, 99, None, "")
    return total


def sample(rng, n):
    L = rng.choice([30, 31, 33, 45, 80, 149], n)
    ref5, ref3 = rng.integers(0, 4, (n, 15)), rng.integers(0, 4, (n, 15))
    change = lambda r: np.where(rng.random(r.shape) < 0.15, rng.integers(0, 5, r.shape), r)
    q = lambda: np.where(rng.random((n, 15)) < 0.1, 255, rng.integers(5, 41, (n, 15)))
    return L, ref5, change(ref5), q(), ref3, change(ref3), q()


@pytest.mark.parametrize("x", [(0.36, 0.01, 0.7, 0.02), (0.05, 0.05, 0.4, 0.3), (0.9, 0.001, 0.99, 1e-4)])
def test_kernel_is_the_sum_over_overhangs_and_nicks(x):
    L, r5, a5, q5, r3, a3, q3 = sample(np.random.default_rng(1), 6)
    got = S.ancient_likelihood(x, L, r5, a5, q5, r3, a3, q3, TOL, compat=False)
    none = S.undamaged_probability(x, L, r5, r3, TOL)
    _, d, ds, _ = x
    for i in range(len(L)):
        want = brute(x, int(L[i]), lambda k, s: factor(r5[i, k], a5[i, k], q5[i, k], s, d, ds), lambda k, s: factor(r3[i, k], a3[i, k], q3[i, k], s, d, ds), True)
        assert got[i] == pytest.approx(want, rel=1e-9)
        want = brute(x, int(L[i]), lambda k, s: clean(r5[i, k], s, d, ds), lambda k, s: clean(r3[i, k], s, d, ds), False)
        assert none[i] == pytest.approx(want, rel=1e-9)


def test_modern_likelihood():
    L, r5, a5, q5, r3, a3, q3 = sample(np.random.default_rng(2), 20)
    got = S.modern_likelihood(r5, a5, q5, r3, a3, q3)
    for i in range(20):
        want = 1.0
        for r, a, q in ((r5, a5, q5), (r3, a3, q3)):
            for k in range(15):
                if r[i, k] < 4 and a[i, k] < 4 and q[i, k] != 255:
                    e = 10 ** (-q[i, k] / 10)
                    want *= 1 - e if r[i, k] == a[i, k] else e / 3
        assert math.isclose(got[i], want, rel_tol=1e-12)


def test_no_damage_without_rates():
    L, r5, a5, q5, r3, a3, q3 = sample(np.random.default_rng(3), 8)
    x = (0.3, 0.0, 0.0, 0.05)
    assert np.allclose(S.ancient_likelihood(x, L, r5, a5, q5, r3, a3, q3, TOL, False), S.modern_likelihood(r5, a5, q5, r3, a3, q3), rtol=1e-6)
    assert np.allclose(S.undamaged_probability(x, L, r5, r3, TOL), 1.0)


def test_reads_without_qualities_say_nothing():
    L, r5, a5, q5, r3, a3, q3 = sample(np.random.default_rng(4), 5)
    none = np.full_like(q5, 255)
    assert np.array_equal(S.modern_likelihood(r5, a5, none, r3, a3, none), np.ones(5))
    x = (0.36, 0.01, 0.7, 0.02)
    for compat in (True, False):
        for turned in (True, False):
            assert np.allclose(S.ancient_likelihood(x, L, r5, a5, none, r3, a3, none, TOL, compat, turned), 1.0, atol=1e-6)


def test_no_length_limit(spark):
    from paleoframe import api
    from paleoframe.schema import Options

    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        n = int(rng.choice([40, 90, 149, 150, 200, 511, 512]))
        ref = rng.integers(0, 4, n).tolist()
        read = [3 if c == 1 and rng.random() < 0.5 * 0.6**i else c for i, c in enumerate(ref)]
        rows.append((k, 0, n, ref, read, [30 if k % 7 else 255] * n))
    df = spark.createDataFrame(rows, "read_id long, flag int, length int, ref array<int>, read array<int>, qual array<int>").cache()
    o = Options(len_limit=0, isrecal=1, eps=0.1)
    got = api.run(df, o)[1].collect()
    assert len(got) == sum(r[2] < 512 for r in rows)
    assert all(0 <= r[c] <= 1 for r in got for c in ("AN", "AO", "PD"))
