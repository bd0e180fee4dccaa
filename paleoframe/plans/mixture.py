"""The two-component length mixture: ancient and modern molecules, each a normal distribution cut to the length window.

What depends on the parameters depends on a read only through its length. So a batch of parameter vectors becomes a small
table of the components' probabilities and derivatives by point and length, which joins the reads on the length, and one
aggregate gives the likelihood, its gradient and its Hessian at all points of the batch. The plan has no parameters in
it, so Spark compiles it once for a fit. The fit takes Newton steps, and tries several lengths of a step in one job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LENGTH_LIMIT, MIN_LENGTH

START, LOW, HIGH = (60.0, 45.0, 100.0, 45.0), (30.0, 15.0, 30.0, 1.0), (149.0, 100.0, 149.0, 100.0)
NAMES = ("mu_anc", "sigma_anc", "mu_mod", "sigma_mod")


#: Shares of a Newton step that are tried at once, and how small the gain or the gradient in the box has to be at the end.
STEPS = (1.0, 0.5, 0.2, 0.05, 0.01)
GAIN, SLOPE = 1e-14, 1e-7


def _normal(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities between neighbouring z, from the nearer tail, and the density at each."""
    tail = np.array([math.erfc(abs(v) / math.sqrt(2)) / 2 for v in z])
    a, b = tail[:-1], tail[1:]
    part = np.where(z[:-1] >= 0, a - b, np.where(z[1:] <= 0, b - a, 1 - a - b))
    return part, np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def length_derivatives(mu: float, sigma: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> np.ndarray:
    """[value, by mu, by sigma, by mu mu, by sigma sigma, by mu sigma][length - low], exactly: the probability of each
    length in the window. Derivatives of the share part / whole follow from those of share * whole = part."""
    z = (np.arange(low, limit + 1) - 0.5 - mu) / sigma
    part, p = _normal(z)
    edge = {"m": -p / sigma, "s": -p * z / sigma, "mm": -p * z / sigma**2, "ss": p * z * (2 - z * z) / sigma**2, "ms": p * (1 - z * z) / sigma**2}
    whole = max(part.sum(), 1e-300)
    share = part / whole
    d = {k: np.diff(v) / whole for k, v in edge.items()}  # of part
    w = {k: (v[-1] - v[0]) / whole for k, v in edge.items()}  # of whole
    m, s = d["m"] - share * w["m"], d["s"] - share * w["s"]
    mm = d["mm"] - 2 * m * w["m"] - share * w["mm"]
    ss = d["ss"] - 2 * s * w["s"] - share * w["ss"]
    ms = d["ms"] - m * w["s"] - s * w["m"] - share * w["ms"]
    return np.array([share, m, s, mm, ss, ms])


def length_probability(mu: float, sigma: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> np.ndarray:
    """[value, by mu, by sigma][length - low]."""
    return length_derivatives(mu, sigma, low, limit)[:3]


def second_derivatives(mu: float, sigma: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> np.ndarray:
    """[by mu mu, by sigma sigma, by mu sigma][length - low]."""
    return length_derivatives(mu, sigma, low, limit)[3:]


def clamped(length: Column, low: int, limit: int) -> Column:
    return F.least(F.greatest(length, F.lit(low)), F.lit(limit - 1))


@dataclass(frozen=True)
class Point:
    """Negative log-likelihood at a point, with its gradient and Hessian."""

    value: float
    gradient: np.ndarray
    hessian: np.ndarray


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
#: The places of second derivatives by one component's own parameters, in the order of length_derivatives.
_OWN = {(0, 0): "a3", (1, 1): "a4", (0, 1): "a5", (2, 2): "m3", (3, 3): "m4", (2, 3): "m5"}


def evaluate_points(reads: DataFrame, points, eps: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> list[Point]:
    """All points, in one job over the reads (l_err, l_anc, length). A read without a density at a point has the least one
    there and no derivatives. The table that is broadcast has a row for each point and length of the window."""
    spark = reads.sparkSession
    rows = []
    for k, x in enumerate(points):
        a, m = (1 - eps) * length_derivatives(x[0], x[1], low, limit), eps * length_derivatives(x[2], x[3], low, limit)
        rows += [(k, low + i, *map(float, a[:, i]), *map(float, m[:, i])) for i in range(limit - low)]
    names = [f"{c}{i}" for c in "am" for i in range(6)]
    table = spark.createDataFrame(rows, "point int, at int, " + ", ".join(f"{n} double" for n in names))
    own = reads.select("l_err", "l_anc", clamped(F.col("length"), low, limit).cast("int").alias("at")).join(F.broadcast(table), "at")
    terms = own.select("point", *[(F.col("l_anc" if n[0] == "a" else "l_err") * F.col(n)).alias(n) for n in names]).withColumn("d", F.col("a0") + F.col("m0"))
    slope, d = ["a1", "a2", "m1", "m2"], F.when(F.col("d") > 0, F.col("d"))
    sums = [F.sum(-F.ln(F.greatest("d", F.lit(1e-300))))] + [F.sum(-F.col(c) / d) for c in slope]
    for i, j in _PAIRS:
        cross = F.col(slope[i]) * F.col(slope[j]) / (d * d)
        sums.append(F.sum(cross - F.col(_OWN[i, j]) / d if (i, j) in _OWN else cross))
    got = {r[0]: [float(v or 0) for v in r[1:]] for r in terms.groupBy("point").agg(*[v.alias(f"v{i}") for i, v in enumerate(sums)]).collect()}
    out = []
    for k in range(len(points)):
        v, h = got.get(k, [0.0] * 15), np.zeros((4, 4))
        for (i, j), x in zip(_PAIRS, v[5:], strict=True):
            h[i, j] = h[j, i] = x
        out.append(Point(v[0], np.array(v[1:5]), h))
    return out


def evaluate(reads: DataFrame, x, eps: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of reads and its gradient."""
    p = evaluate_points(reads, [x], eps, low, limit)[0]
    return p.value, p.gradient


def hessian(reads: DataFrame, x, eps: float, low: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> np.ndarray:
    return evaluate_points(reads, [x], eps, low, limit)[0].hessian


@dataclass(frozen=True)
class MixtureFit:
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    llh: float
    calls: int  # points evaluated
    jobs: int = field(default=0, compare=False)

    def row(self) -> dict:
        number = lambda v: float(v) if np.isfinite(v) else None
        out = {}
        for i, n in enumerate(NAMES):
            out |= {n: float(self.x[i]), f"{n}_low": number(self.low[i]), f"{n}_high": number(self.high[i])}
        return out | {"llh": self.llh, "calls": self.calls, "jobs": self.jobs}


def _step(p: Point, free: np.ndarray) -> np.ndarray:
    """Newton's step in the free parameters; directions of no or negative curvature count as if curved the other way."""
    w, v = np.linalg.eigh(p.hessian[np.ix_(free, free)])
    w = np.maximum(np.abs(w), 1e-8 * max(np.abs(w).max(), 1e-8))
    out = np.zeros(len(p.gradient))
    out[free] = -v @ ((v.T @ p.gradient[free]) / w)
    return out


def minimise_points(many, x, low, high, steps: int = 200) -> tuple[np.ndarray, Point, int, int]:
    """Newton's method in a box. many evaluates a list of points at once; x, its Point, points evaluated and calls."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x, float), low, high)
    best, seen, jobs = many([x])[0], 1, 1
    for _ in range(steps):
        g = best.gradient
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(np.clip(x - g, low, high) - x).max() <= SLOPE:
            break
        move, found = _step(best, free), None
        for shrink in (1.0, 1e-3):
            tries = [np.clip(x + shrink * t * move, low, high) for t in STEPS]
            # beside the bent step, the one along the slope in the box
            if shrink < 1:
                tries.append(np.clip(x - np.where(free, g, 0) * shrink / max(np.abs(g).max(), 1e-300), low, high))
            got = many(tries)
            seen, jobs = seen + len(tries), jobs + 1
            good = [(p.value, k) for k, p in enumerate(got) if np.isfinite(p.value) and p.value <= best.value + 1e-4 * min(0.0, g @ (tries[k] - x))]
            if good:
                found = min(good)[1]
                break
        if found is None:
            break
        gain = best.value - got[found].value
        x, best = tries[found], got[found]
        if gain <= GAIN * max(abs(best.value), 1.0):
            break
    return x, best, seen, jobs


def fit_mixture(reads: DataFrame, eps: float, len_min: int = MIN_LENGTH, limit: int = LENGTH_LIMIT) -> MixtureFit:
    """Fit to the rows (l_err, l_anc, length), which stay where they are; intervals are null at a bound."""
    reads = reads.select("l_err", "l_anc", "length").persist()
    try:
        x, best, calls, jobs = minimise_points(lambda points: evaluate_points(reads, points, eps, len_min, limit), START, LOW, HIGH)
    finally:
        reads.unpersist()
    free = (x > LOW) & (x < HIGH)
    half = np.full(4, np.nan)
    if free.any():
        try:
            with np.errstate(invalid="ignore"):
                half[free] = 1.96 * np.sqrt(np.diag(np.linalg.inv(best.hessian[np.ix_(free, free)])))
        except np.linalg.LinAlgError:
            pass
    return MixtureFit(x, x - half, x + half, -best.value, calls, jobs)
