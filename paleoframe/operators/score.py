"""Scoring of reads: likelihoods under the modern and the ancient model and posterior probabilities.

The ancient likelihood sums over overhangs (l, r) and nick places. Given the two overhangs the factors of the left end
depend only on (l, nick) and those of the right end only on (r, nick), so for each read prefix sums of three log-factors
an end (single strand, double strand before and after the nick) give every product, and the weights depend on the
length alone: the sums are tables by length, times small arrays by read. The kernel works on whole Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.mixture import length_probability
from ..schema import MIN_LENGTH, NO_QUALITY, POSITIONS, Options
from .reads import ends

N = POSITIONS
ALMOST_ONE, ALMOST_ZERO = 1 - 1e-8, 1e-8
NO_BASE = 4


@dataclass(frozen=True)
class Weights:
    """By length: what the products of the ends are summed with."""

    both: np.ndarray  # [l, r, k], both overhangs short: nick in a window, at the last place, elsewhere
    left: np.ndarray  # [l, nick], right overhang long: nick in the left window
    left_rest: np.ndarray  # [l]
    right: np.ndarray  # [r, m], left overhang long: nick m places from the right end
    right_rest: np.ndarray  # [r]
    rest: float  # neither


@lru_cache(maxsize=4096)
def weights(x: tuple, length: int, tol: float, damage: bool) -> Weights:
    """damage: for the ancient likelihood; else for the probability of no damage, whose windows differ a little: the
    right one begins a place later, and a nick at the last place has no weight of its own where the right overhang is
    long."""
    lam, _, _, nu = x
    L, q = length, (1 - lam) ** (length - 1)
    first = N if damage else N - 1
    over = np.arange(L - 1)
    p = 0.5 * lam * (1 - lam) ** over / (1 - q)
    p[0] += 0.5
    dp = 4 * p[:, None] * p[None, :] / (3 + (1 - q - (L - 1) * lam * q) / (1 - q) ** 2)
    D = 1 + (L - over[:, None] - over[None, :] - 2) * nu
    k = np.arange(N + 1)
    near, w, last = dp[: N + 1, : N + 1], nu / D[: N + 1, : N + 1], (1 - nu) / D[: N + 1, : N + 1] * (k <= first)
    used = (N - k[:, None]) * w + np.maximum(0, first - k) * w + last
    both = np.where(near > tol, near, 0.0)[..., None] * np.stack([w, last, 1 - used], 2)
    left, left_rest = np.zeros((N + 1, N)), np.zeros(N + 1)
    right, right_rest = np.zeros((N + 1, N + 1)), np.zeros(N + 1)
    total = dp[: N + 1, : N + 1].sum()
    for a in range(N + 1):
        far = np.arange(N + 1, L - 1 - a)  # a long overhang on the other side, of any place that is left
        total += dp[a, far].sum() + dp[far, a].sum()
        for weight, ok, table, rest, places in (
            (dp[a, far], dp[a, far] >= tol, left, left_rest, range(a, N)),
            (dp[far, a], dp[far, a] > tol, right, right_rest, range(a, N + 1)),
        ):
            w, last, used = nu / D[a, far], (1 - nu) / D[a, far], np.zeros(len(far))
            for k in places:  # of the nick, from the end with the short overhang
                if table is right:
                    at_end = np.full(len(far), k == a)
                else:
                    at_end = (k == L - far - 1) & damage
                v = np.where(k <= L - far - 1, np.where(at_end, last, w), 0.0)
                table[a, k] = (weight * v)[ok].sum()
                used += v
            rest[a] = (weight * (1 - used))[ok].sum()
    return Weights(both, left, left_rest, right, right_rest, 1 - total if 1 - total > tol else 0.0)


def _tables(x: tuple, lengths: np.ndarray, tol: float, damage: bool):
    own, at = np.unique(lengths, return_inverse=True)
    w = [weights(x, int(n), tol, damage) for n in own]
    stack = lambda name: np.stack([getattr(v, name) for v in w])[at]
    return {n: stack(n) for n in ("both", "left", "left_rest", "right", "right_rest", "rest")}


def _prefix(a: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(a), 1)), np.cumsum(a, 1)], 1)


_K = np.arange(N + 1)


def _end_products(single: np.ndarray, before: np.ndarray, after: np.ndarray):
    """From log-factors [read, place]: products with an overhang of k places and a nick after place m, [read, k, m]
    (m < k: as if m = k - 1), and without a nick, [read, k]."""
    s, b, a = _prefix(single), _prefix(before), _prefix(after)
    cut = np.maximum(np.minimum(_K + 1, N)[None, :], _K[:, None])  # [k, m]: the first place after the nick
    nicked = s[:, :, None] + b[:, cut] - b[:, :, None] + a[:, N, None, None] - a[:, cut]
    return np.exp(nicked), np.exp(s + b[:, N, None] - b)


def _combine(left, right, t, last_left, last_right, window_left=None):
    """Sum over overhangs and nicks. left, right: of _end_products; last_*: products of whole single-strand ends;
    window_left: products of the left end without a nick to take while the nick is in the right window."""
    (ln, lf), (rn, rf) = left, right
    wf = lf if window_left is None else window_left
    ks = np.arange(N + 1)
    in_left = np.where((np.arange(N)[None, :] >= ks[:, None])[None], ln[:, :, :N], 0.0)
    first = t["first"]
    in_right = np.where(((ks[None, :] > ks[:, None]) & (ks[None, :] <= first))[None], rn, 0.0).sum(2)
    at_last = rn[:, ks, ks]
    both = t["both"]
    out = np.einsum("nl,nr,nlr->n", in_left.sum(2), rf, both[..., 0]) + np.einsum("nl,nr,nlr->n", wf, in_right, both[..., 0])
    out += np.einsum("nl,nr,nlr->n", wf, at_last, both[..., 1]) + np.einsum("nl,nr,nlr->n", lf, rf, both[..., 2])
    out += last_right * ((in_left * t["left"]).sum((1, 2)) + (lf * t["left_rest"]).sum(1))
    out += last_left * ((rn * t["right"]).sum((1, 2)) + (rf * t["right_rest"]).sum(1))
    return out


def _error(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q / 10.0)


def _seen(ref: np.ndarray, read: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Bases that say something: both have a code, and how certain the read one is is known."""
    return (ref < NO_BASE) & (read < NO_BASE) & (q != NO_QUALITY)


def modern_likelihood(ref5, read5, qual5, ref3, read3, qual3) -> np.ndarray:
    """Product of 1 - e for a match and e / 3 for a mismatch over the bases of both ends; bases that are missing or have
    no quality are left out."""
    out = np.zeros(len(ref5))
    with np.errstate(divide="ignore"):
        for ref, read, q in ((ref5, read5, qual5), (ref3, read3, qual3)):
            e = _error(q)
            out += np.where(_seen(ref, read, q), np.log(np.where(ref == read, 1 - e, e / 3)), 0.0).sum(1)
    return np.exp(out)


def _factors(ref, read, q, extra: float, base: int, to: int, floor: float = ALMOST_ONE) -> np.ndarray:
    """Log-factors where ``base`` turns to ``to`` with the additional rate ``extra``."""
    e = _error(q)
    d = extra * (1 - 4 * e / 3)
    match = np.maximum(1 - e, ALMOST_ZERO)
    other = np.minimum(e / 3, floor)
    value = np.where(ref == read, match, other)
    hit = ref == base
    value = np.where(hit & (read == base), np.maximum(1 - e - d, ALMOST_ZERO), value)
    value = np.where(hit & (read == to), np.minimum(e / 3 + d, ALMOST_ONE), value)
    return np.where(_seen(ref, read, q), np.log(value), 0.0)


def ancient_likelihood(x, lengths, ref5, read5, qual5, ref3, read3, qual3, tol: float, compat: bool, turned: bool = False) -> np.ndarray:
    """On the strand of the read. turned: the arrays are those of the reverse complement."""
    _, d, ds, _ = x
    C, G, T_, A = 1, 2, 3, 0
    left = [_factors(ref5, read5, qual5, r, *s) for r, s in ((ds, (C, T_)), (d, (C, T_)), (d, (G, A)))]
    right = [_factors(ref3, read3, qual3, r, *s) for r, s in ((ds, (G, A)), (d, (G, A)), (d, (C, T_)))]
    t = _tables(tuple(x), lengths, tol, True) | {"first": N}
    whole_l, whole_r = np.exp(left[0].sum(1)), np.exp(right[0].sum(1))
    window = None
    if compat and turned:  # there an unexplained mismatch of the left end has the smallest factor
        odd = (ref5 != read5) & _seen(ref5, read5, qual5) & ~((ref5 == C) & (read5 == T_)) & ~((ref5 == G) & (read5 == A))
        least = np.log(np.minimum(_error(qual5) / 3, ALMOST_ZERO))
        s, b = (_prefix(np.where(odd, least, f)) for f in left[:2])
        window = np.exp(s + b[:, N, None] - b)
    out = _combine(_end_products(*left), _end_products(*right), t, whole_l, whole_r, window)
    rest_l = whole_l
    if compat and not turned:  # with both overhangs long, a C to T change has the full rate added
        e = _error(qual5) / 3
        rest_l = np.exp(np.where((ref5 == C) & (read5 == T_) & (qual5 != NO_QUALITY), np.log(np.minimum(e + ds, ALMOST_ONE)), left[0]).sum(1))
    return out + rest_l * whole_r * t["rest"]


def undamaged_probability(x, lengths, ref5, ref3, tol: float) -> np.ndarray:
    """That no base of an ancient molecule's ends is damaged, given the reference bases."""
    _, d, ds, _ = x
    with np.errstate(divide="ignore"):
        single, double = np.log(1 - ds), np.log(1 - d)
    left = [np.where(ref5 == b, v, 0.0) for b, v in ((1, single), (1, double), (2, double))]
    right = [np.where(ref3 == b, v, 0.0) for b, v in ((2, single), (2, double), (1, double))]
    t = _tables(tuple(x), lengths, tol, False) | {"first": N - 1}
    whole_l, whole_r = np.exp(left[0].sum(1)), np.exp(right[0].sum(1))
    return _combine(_end_products(*left), _end_products(*right), t, whole_l, whole_r) + whole_l * whole_r * t["rest"]


def _flip(a: np.ndarray) -> np.ndarray:
    return np.where(a < NO_BASE, 3 - a, NO_BASE)


KERNEL = [T.StructField(c, T.DoubleType()) for c in ("l_err", "l_anc", "l_none")]


def likelihoods(x, lengths, ref5, read5, qual5, ref3, read3, qual3, model: str, tol: float, compat: bool) -> list[np.ndarray]:
    l_err = modern_likelihood(ref5, read5, qual5, ref3, read3, qual3)
    l_anc = ancient_likelihood(x, lengths, ref5, read5, qual5, ref3, read3, qual3, tol, compat)
    none = undamaged_probability(x, lengths, ref5, ref3, tol)
    if model == "nb":
        turned = [_flip(ref3), _flip(read3), qual3, _flip(ref5), _flip(read5), qual5]
        l_anc = (l_anc + ancient_likelihood(x, lengths, *turned, tol, compat, turned=True)) / 2
        none = (none + undamaged_probability(x, lengths, turned[0], turned[3], tol)) / 2
    return [l_err, l_anc, none]


def read_likelihoods(aligned: DataFrame, x, o: Options = Options()) -> DataFrame:
    """The aligned reads with l_err, l_anc and l_none, computed once each, instead of their base arrays.

    Reads under 15 bases have no complete ends and have to be filtered out before.
    """
    rows = ends(aligned)
    arrays = ["ref5", "read5", "qual5", "ref3", "read3", "qual3"]
    keep = [f for f in rows.schema.fields if f.name not in arrays + [k.name for k in KERNEL]]
    names = [f.name for f in keep]
    x = tuple(float(v) for v in x)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = [part.column(c).flatten().to_numpy().reshape(-1, N) for c in arrays]
                got = likelihoods(x, part.column("length").to_numpy(), *own, o.model, o.tolerance, o.compat)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *map(pa.array, got)], names + [k.name for k in KERNEL])

    return rows.mapInArrow(run, T.StructType(keep + KERNEL))


def _bounded(p: Column) -> Column:
    return F.when(F.isnan(p), p).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def posterior(scored: DataFrame, o: Options = Options(), mixture=None, len_min: int = MIN_LENGTH) -> DataFrame:
    """AN and PD, and AO with a fitted mixture (isrecal 1): AO without lengths, AN with them. 32-bit floats."""

    def ancient(p_anc: Column, p_mod: Column) -> Column:
        a, m = F.col("l_anc") * (1 - o.eps) * p_anc, F.col("l_err") * o.eps * p_mod
        return _bounded(F.try_divide(a, a + m)).cast("float")

    one = F.lit(1.0)
    plain = ancient(one, one)
    out = scored
    if o.isrecal == 1 and mixture is not None:
        at = (F.least(F.greatest("length", F.lit(len_min)), F.lit(o.limit - 1)) - len_min + 1).cast("int")
        table = lambda mu, si: F.element_at(F.lit([float(v) for v in length_probability(mu, si, len_min, o.limit)[0]]), at)
        out = out.withColumn("AO", plain).withColumn("AN", ancient(table(*mixture[:2]), table(*mixture[2:])))
    else:
        out = out.withColumn("AN", plain)
    return out.withColumn("PD", _bounded(1 - F.try_divide(F.col("l_none") * F.col("l_err"), F.col("l_anc"))).cast("float"))


def native_log_error(aligned: DataFrame) -> DataFrame:
    """read columns with ln_err, the logarithm of the modern likelihood, by SQL functions only."""
    rows = ends(aligned)
    part = None
    for e in ("5", "3"):
        cells = F.arrays_zip(F.col(f"ref{e}").alias("a"), F.col(f"read{e}").alias("b"), F.col(f"qual{e}").alias("q"))

        def step(acc, c):
            err = F.pow(F.lit(10.0), -c["q"] / F.lit(10.0))
            value = F.when(c["a"] == c["b"], 1 - err).otherwise(err / 3)
            log = F.when(value <= 0, F.lit(float("-inf"))).otherwise(F.ln(value))
            return acc + F.when((c["a"] < NO_BASE) & (c["b"] < NO_BASE) & (c["q"] != NO_QUALITY), log).otherwise(0.0)

        own = F.aggregate(cells, F.lit(0.0), step)
        part = own if part is None else part + own
    return rows.withColumn("ln_err", part).drop("ref5", "read5", "qual5", "ref3", "read3", "qual3")
