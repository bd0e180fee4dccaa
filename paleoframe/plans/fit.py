"""Fitting the damage model to a profile, overall or by taxon."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import mismatch_wide, profile
from ..schema import POSITIONS
from .model import Profile, loss, loss_hessian, naive_loss
from .optimize import minimise, newton_polish

NAMES = ("lambda", "delta", "delta_s", "nu")
FIT_SCHEMA = ", ".join(f"{n} double, {n}_low double, {n}_high double" for n in NAMES) + ", llh double, calls int"


#: Parameters lie between this and one minus this.
EDGE = 1e-8


@dataclass(frozen=True)
class Fit:
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray
    llh: float
    calls: int
    covariance: np.ndarray

    def row(self) -> dict:
        number = lambda v: float(v) if np.isfinite(v) else None
        out = {}
        for i, n in enumerate(NAMES):
            out |= {n: float(self.x[i]), f"{n}_low": number(self.low[i]), f"{n}_high": number(self.high[i])}
        return out | {"llh": self.llh, "calls": self.calls}


def fit_profile(p: Profile, model: str = "nb", eps: float = 0.0) -> Fit:
    """Two stages: the naive model from (.2, .1, .1), then the full one from there with nu = .01 and a
    few Newton steps at the end. 95 % intervals."""
    first = minimise(lambda x: naive_loss(x, p), (0.2, 0.1, 0.1), np.zeros(3), np.ones(3))
    low, high = np.full(4, EDGE), np.full(4, 1 - EDGE)
    best = minimise(lambda x: loss(x, p, model, eps), (*first.x, 0.01), low, high)
    x, value, more = newton_polish(lambda x: loss(x, p, model, eps), lambda x: loss_hessian(x, p, model, eps), best.x, low, high)
    h = loss_hessian(x, p, model, eps)
    try:
        cov = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        cov = np.full((4, 4), np.nan)
    with np.errstate(invalid="ignore"):
        half = 1.96 * np.sqrt(np.where((x <= low) | (x >= high), np.nan, np.diag(cov)) / p.max_all)
    return Fit(x, x - half, x + half, -value, best.calls + more, cov)


def profile_of(counts: DataFrame, lengths: DataFrame) -> Profile:
    """From (end, dist, ref, read, n) and (length, freq): 30 and at most some hundred rows reach the driver."""
    rows = profile(mismatch_wide(counts)).collect()
    lens = sorted((r["length"], r["freq"]) for r in lengths.collect())
    return Profile.of(rows, [a for a, _ in lens], [b for _, b in lens])


def fit_by(counts: DataFrame, lengths: DataFrame, by: str, model: str = "nb", eps: float = 0.0) -> DataFrame:
    """A fit for each group of ``by`` in counts (by, end, dist, ref, read, n) and lengths (by, length, n).

    A group is 30 profile rows and a histogram, however many reads it has. Groups without all positions have no fit.
    """
    prof = profile(mismatch_wide(counts, by), by)
    kind = counts.schema[by].dataType.simpleString()
    packed = (
        prof.groupBy(by)
        .agg(F.sort_array(F.collect_list(F.struct("idx", "freq_ct", "freq_ga", "scale_ct", "scale_ga", "seq_err", "max_all"))).alias("p"))
        .where(F.size("p") == 2 * POSITIONS)
        .join(lengths.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("length", "n"))).alias("h")), by)
    )

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for group, p, h in zip(frame[by], frame["p"], frame["h"], strict=True):
                n = np.array([x["n"] for x in h], float)
                f = fit_profile(Profile.of(list(p), [x["length"] for x in h], n / n.sum()), model, eps)
                out.append({by: group} | f.row())
            yield pd.DataFrame(out, columns=[by, *(c.split()[0] for c in FIT_SCHEMA.split(", "))])

    # a packed group is small but takes a fit: dealt out by count, which Spark doesn't merge by size
    spread = packed.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    return spread.mapInPandas(run, f"{by} {kind}, {FIT_SCHEMA}")
