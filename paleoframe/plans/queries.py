"""One query an operator family over the driver's tables, with the same result in SQL where SQL can express it.

Counts are exact; doubles are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as FB
from ..operators import lengths as OL
from ..operators import profile as OP
from ..operators import reads as OR
from ..operators import reference as OREF
from ..operators import score as OS
from ..schema import CELLS, LENGTH_LIMIT, MIN_LENGTH, POSITIONS, Options
from ..sources import derived as D
from . import fit as PF
from . import fit_sql as FS
from . import mixture as PM
from . import model as DM
from . import score_sql as SS

#: Fixed parameters (lambda, delta, delta_s, nu) and mixture of queries that don't fit them.
X = (0.36, 0.01, 0.7, 0.02)
MIX = (60.0, 20.0, 110.0, 30.0)
EPS = 0.1
ANY = Options(single_end=True)


def events(spark: SparkSession, d: str) -> DataFrame:
    return D.spread(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"))


def all_reads(spark, d):
    return D.reads(events(spark, d))


def reads(spark, d):
    return OR.eligible(all_reads(spark, d))


def aligned(spark, d):
    return D.with_bases(reads(spark, d))


def aligned_ends(spark, d):
    """Rows that hold only the bases which scores look at."""
    return D.with_bases(reads(spark, d), POSITIONS)


def base_rows(spark, d, *keep):
    return OR.orient(D.stored_bases(reads(spark, d), *keep), ("read_id", *keep))


def counts(spark, d, *by):
    return OP.mismatch_counts(base_rows(spark, d, *by), *by)


def wide(spark, d, *by):
    return OP.mismatch_wide(counts(spark, d, *by), *by)


def profile(spark, d):
    return OP.profile(wide(spark, d))


def rounded(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


# SQL shared by the oracles

_CTE = f"""WITH reads AS ({D.READS_SQL}), eligible AS ({D.ELIGIBLE_SQL})
, bases AS (SELECT * FROM ({D.BASES_SQL}) WHERE ref < 4 AND read < 4)
, near AS (SELECT *, '5''' AS "end", dist5 AS dist FROM bases WHERE dist5 < {POSITIONS} UNION ALL
  SELECT *, '3''' AS "end", dist3 AS dist FROM bases WHERE dist3 < {POSITIONS})
, mm AS (SELECT "end", dist, ref, read, count(*) AS n FROM near GROUP BY ALL)
"""
_CELL_SUMS = ", ".join(f"CAST(coalesce(sum(CASE WHEN ref = {k // 4} AND read = {k % 4} THEN n END), 0) AS BIGINT) AS \"{c}\"" for k, c in enumerate(CELLS))
_WIDE = f""", wide AS (SELECT "end", dist, {_CELL_SUMS} FROM mm GROUP BY "end", dist)
"""
_PROFILE = """, part AS (SELECT "end", dist, CAST(CA + CC + CG + CT AS DOUBLE) AS c, CAST(GA + GC + GG + GT AS DOUBLE) AS g, CT, GA,
  1 - CAST(AA + TT AS DOUBLE) / (AA + AC + AG + "AT" + TA + TC + TG + TT) AS err FROM wide)
, folded AS (SELECT a.idx, freq_ct, freq_ga, scale_ct, scale_ga, seq_err FROM
  (SELECT CASE WHEN "end" = '5''' THEN dist ELSE 29 - dist END AS idx, CT / c AS freq_ct, c AS scale_ct, err AS seq_err FROM part) a JOIN
  (SELECT CASE WHEN "end" = '5''' THEN 29 - dist ELSE dist END AS idx, GA / g AS freq_ga, g AS scale_ga FROM part) b USING (idx))
, prof AS (SELECT idx, freq_ct, freq_ga, scale_ct / m AS scale_ct, scale_ga / m AS scale_ga, seq_err, m AS max_all
  FROM folded, (SELECT max(greatest(scale_ct, scale_ga)) AS m FROM folded))
"""
_HIST = ", hist AS (SELECT length, count(*) AS n FROM eligible GROUP BY length)\n"
SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_CTE + "SELECT flag, count(*) AS n, min(mapq) AS least_mapq FROM eligible WHERE mapq >= 10 GROUP BY flag")
def read_filter_flags(spark, d):
    kept = OR.eligible(all_reads(spark, d), Options(min_mapq=10))
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.min("mapq").alias("least_mapq"))


@query(_CTE + "SELECT (flag & 3584) <> 0 AS failed, (flag & 1) = 1 AS paired, count(*) AS n FROM reads GROUP BY ALL")
def read_failed_flags(spark, d):
    r = all_reads(spark, d)
    return r.groupBy(OR.failed().alias("failed"), (F.col("flag").bitwiseAND(F.lit(1)) == 1).alias("paired")).agg(F.count(F.lit(1)).alias("n"))


@query(_CTE + "SELECT length, count(*) AS n FROM eligible GROUP BY length")
def read_length_histogram(spark, d):
    return OL.length_histogram(reads(spark, d))


@query(
    _CTE + _HIST + "SELECT l.length, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM hist), 9) AS freq "
    "FROM (SELECT CAST(unnest(range((SELECT min(length) FROM hist), (SELECT max(length) + 1 FROM hist))) AS INT) AS length) l LEFT JOIN hist USING (length)"
)
def length_dist_gapfilled(spark, d):
    return rounded(OL.gap_filled(OL.length_histogram(reads(spark, d))), 9, "freq")


@query(_CTE + "SELECT greatest(min(length), 30) AS len_min FROM reads")
def length_min(spark, d):
    return OL.shortest(all_reads(spark, d))


@query(_CTE + ", h AS (SELECT length, count(*) AS w FROM reads WHERE length < 150 GROUP BY length) SELECT length, round(w / CAST(sum(w) OVER () AS DOUBLE), 9) AS freq FROM h")
def length_dist_normalised(spark, d):
    h = OL.length_histogram(all_reads(spark, d)).withColumnRenamed("n", "weight")
    return rounded(OL.normalised(h), 9, "freq")


@query(
    _CTE + ", h AS (SELECT length, count(*) AS w FROM reads GROUP BY length), s AS (SELECT length, round(w / CAST(sum(w) OVER () AS DOUBLE), 9) AS freq FROM h) "
    "SELECT * FROM s WHERE length > 0 AND length < 150"
)
def length_dist_rlens_style(spark, d):
    h = OL.length_histogram(all_reads(spark, d)).withColumnRenamed("n", "weight")
    return rounded(OL.normalised_by_all(h), 9, "freq")


@query(_CTE + "SELECT read_id, dist5, dist3, ref, read, qual FROM bases")
def base_orient(spark, d):
    return OR.end_bases(aligned(spark, d))


@query(_CTE + "SELECT CASE WHEN read < 4 THEN 3 - read ELSE 4 END AS code, substr('ACGTN', 1 + CASE WHEN read < 4 THEN 3 - read ELSE 4 END, 1) AS letter, count(*) AS n FROM bases GROUP BY ALL")
def base_complement(spark, d):
    code = FB.complement("read").cast("int")
    return base_rows(spark, d).groupBy(code.alias("code"), FB.base_letter(code).alias("letter")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT b, CASE WHEN upper(b) IN ('A', 'C', 'G', 'T') THEN instr('ACGT', upper(b)) - 1 WHEN b IN ('0', '1', '2', '3') THEN CAST(b AS INT) ELSE 4 END AS code, count(*) AS n "
    "FROM (SELECT unnest(string_split(text, '')) AS b FROM documents) WHERE b <> '' GROUP BY b"
)
def base_decode(spark, d):
    letters = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "")).alias("b")).where("b <> ''")
    return letters.groupBy("b").agg(F.count(F.lit(1)).alias("n")).withColumn("code", FB.base_code("b").cast("int"))


_ERR = "CASE WHEN qual <> 255 THEN pow(10.0, -qual / 10.0) END"


@query(_CTE + f"SELECT qual, count(*) AS n, round({_ERR}, 12) AS err, round({_ERR} / 3, 12) AS third FROM bases GROUP BY qual")
def phred_error(spark, d):
    e = FB.phred_error("qual")
    n = base_rows(spark, d).groupBy("qual").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns({"err": F.round(e, 12), "third": F.round(e / 3, 12)})


@query(_CTE + 'SELECT "end", dist, ref, read, n FROM mm')
def mismatch_long(spark, d):
    return counts(spark, d)


@query(_CTE + _WIDE + "SELECT * FROM wide")
def mismatch_wide(spark, d):
    return wide(spark, d)


@query(_CTE + 'SELECT taxid, "end", dist, ref, read, count(*) AS n FROM near GROUP BY ALL')
def mismatch_by_taxon(spark, d):
    return counts(spark, d, "taxid")


@query(
    _CTE + ', r AS (SELECT taxid, count(*) AS n_reads FROM eligible GROUP BY taxid) '
    'SELECT taxid, "end", dist, ref, read, CAST(sum(mapq) AS BIGINT) AS w, n_reads FROM near JOIN r USING (taxid) GROUP BY taxid, "end", dist, ref, read, n_reads'
)
def mismatch_weighted(spark, d):
    return OP.weighted_counts(base_rows(spark, d, "taxid", "mapq"), reads(spark, d), "taxid", "mapq")


@query(_CTE + 'SELECT taxid, count(*) AS n_reads FROM eligible GROUP BY taxid HAVING count(*) > 0')
def taxa_with_reads(spark, d):
    return reads(spark, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n_reads")).where("n_reads > 0")


@query(_CTE + _WIDE + _PROFILE + "SELECT idx, round(freq_ct, 9) AS freq_ct, round(freq_ga, 9) AS freq_ga FROM prof")
def profile_freq(spark, d):
    return rounded(profile(spark, d).select("idx", "freq_ct", "freq_ga"), 9, "freq_ct", "freq_ga")


@query(_CTE + _WIDE + _PROFILE + "SELECT idx, round(scale_ct, 9) AS scale_ct, round(scale_ga, 9) AS scale_ga, max_all FROM prof")
def profile_scale(spark, d):
    return rounded(profile(spark, d).select("idx", "scale_ct", "scale_ga", "max_all"), 9, "scale_ct", "scale_ga")


@query(_CTE + _WIDE + _PROFILE + "SELECT idx, round(seq_err, 9) AS seq_err FROM prof")
def profile_seq_error(spark, d):
    return rounded(profile(spark, d).select("idx", "seq_err"), 9, "seq_err")


@query(_CTE + _WIDE + _PROFILE + "SELECT idx, round(freq_ct, 9) AS freq_ct, round(freq_ga, 9) AS freq_ga FROM prof WHERE idx < 5")
def profile_top5(spark, d):
    return rounded(profile(spark, d).where("idx < 5").select("idx", "freq_ct", "freq_ga"), 9, "freq_ct", "freq_ga")


@query(_CTE + 'SELECT "end", dist, ref, read, n, round(n / CAST(sum(n) OVER (PARTITION BY "end", dist, ref) AS DOUBLE), 9) AS rate FROM mm')
def substitution_rates(spark, d):
    return rounded(OP.substitution_rates(counts(spark, d)), 9, "rate")


@query(
    _CTE + """, t AS (SELECT taxid, "end", dist, ref, read, count(*) AS n FROM near WHERE dist < 5 GROUP BY ALL)
, s AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY taxid, "end", dist, ref) AS DOUBLE) AS rate FROM t)
, k AS (SELECT taxid, count(*) AS n_reads FROM eligible GROUP BY taxid)
SELECT taxid, dist, n_reads, round(sum(CASE WHEN "end" = '5''' AND ref = 1 AND read = 3 THEN rate ELSE 0 END) * n_reads, 6) AS ct,
  round(sum(CASE WHEN "end" = '3''' AND ref = 2 AND read = 0 THEN rate ELSE 0 END) * n_reads, 6) AS ga,
  round(sum(CASE WHEN ref <> read AND NOT ("end" = '5''' AND ref = 1 AND read = 3) AND NOT ("end" = '3''' AND ref = 2 AND read = 0) THEN rate ELSE 0 END) / 10 * n_reads, 6) AS other
FROM s JOIN k USING (taxid) GROUP BY taxid, dist, n_reads"""
)
def bdamage_summary(spark, d):
    n = reads(spark, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n_reads"))
    return rounded(OP.damage_summary(counts(spark, d, "taxid"), n, "taxid", 5), 6, "ct", "ga", "other")


_GRID = [(lam, de, ds) for lam in (0.2, 0.36, 0.6) for de in (0.005, 0.02) for ds in (0.3, 0.7)]
_GRID_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in _GRID) + ") g(lam, de, ds)"


@query(
    _CTE + _WIDE + _PROFILE + f"""SELECT lam, de, ds, round(-sum(scale_ct * (freq_ct * ln(de + s * (ds - de)) + (1 - freq_ct) * ln(1 - de - s * (ds - de)))
  + scale_ga * (freq_ga * ln(s * ds) + (1 - freq_ga) * ln(1 - s * ds))), 6) AS llh
FROM (SELECT *, pow(1 - lam, idx + 1) / 2 AS s FROM prof, {_GRID_SQL} WHERE idx < 15) GROUP BY ALL"""
)
def naive_loglike_grid(spark, d):
    p = DM.Profile.of(profile(spark, d).collect(), [], [])
    rows = [(*x, DM.naive_loss(x, p)[0]) for x in _GRID]
    return rounded(spark.createDataFrame(rows, "lam double, de double, ds double, llh double"), 6, "llh")


# the model's rates in SQL: a relation over overhangs


def _weight(k: str, lam: str) -> str:
    return f"CASE WHEN {k} = 0 THEN 1 + {lam} ELSE {lam} * pow(1 - {lam}, {k}) END"


def _rate_columns(model: str, x) -> dict[str, str]:
    lam, de, ds, _ = (f"{v}::DOUBLE" for v in x)
    p4 = f"pow(1 - {lam}, n + 1) / 2"
    if model == "b":
        return {
            "ct5": f"(1 - {p4} - pl) * {de} + {p4} * {ds}", "ga3": f"pr * {de} + {p4} * {ds}",
            "ct3": f"(1 - {p4} - pr) * {de}", "ga5": f"pl * {de}",
        }
    one, two = f"(pr + 1 - {p4} - pl) / 2 * {de} + {p4} * {ds}", f"(pl + 1 - {p4} - pr) / 2 * {de}"
    return {"ct5": one, "ga3": one, "ct3": two, "ga5": two}


def _cube_sql(model: str, x=X) -> str:
    lam, nu = f"{x[0]}::DOUBLE", f"{x[3]}::DOUBLE"
    return f"""cells AS (SELECT CAST(n AS BIGINT) AS n, CAST(len AS BIGINT) AS len, l, r, ({_weight("l", lam)}) * ({_weight("r", lam)}) * {nu} / (1 + (len - 2 - l - r) * {nu}) / 4 AS w
  FROM range(15) a(n), range(30, 150) b(len), range(16) c(l), range(16) e(r) WHERE l + r <= 15)
, nick AS (SELECT n, len, sum(CASE WHEN l <= n AND r <= len - n - 1 THEN w * (n - l) ELSE 0 END) AS pl,
  sum(CASE WHEN r <= n AND l <= len - n - 1 THEN w * (len - n - 1 - l) ELSE 0 END) AS pr FROM cells GROUP BY n, len)
, cube AS (SELECT n, len, {", ".join(f"{v} AS {k}" for k, v in _rate_columns(model, x).items())} FROM nick)"""


def rate_cube(spark: SparkSession, model: str) -> DataFrame:
    """n, len, ct5, ga3, ct3, ga5 at the parameters X."""
    ct, ga = DM.rate_cube(X, model)
    far = 2 * POSITIONS - 1
    rows = [(n, k + MIN_LENGTH, *map(float, (ct[k, n], ga[k, n], ct[k, far - n], ga[k, far - n]))) for k in range(len(ct)) for n in range(POSITIONS)]
    return spark.createDataFrame(rows, "n long, len long, ct5 double, ga3 double, ct3 double, ga5 double")


_RATES = ("ct5", "ga3", "ct3", "ga5")


def _cube_query(model: str) -> str:
    return _CTE + _HIST + ", " + _cube_sql(model) + "SELECT cube.n, len, hist.n AS n_reads, " + ", ".join(f"round({c}, 9) AS {c}" for c in _RATES) + " FROM cube JOIN hist ON len = length"


def of_lengths(spark, d, df: DataFrame) -> DataFrame:
    """``df`` for the lengths that reads have, with their numbers."""
    hist = OL.length_histogram(reads(spark, d)).select(F.col("length").cast("long").alias("len"), F.col("n").alias("n_reads"))
    return df.join(hist, "len")


@query(_cube_query("b"))
def deam_rate_cube_b(spark, d):
    return rounded(of_lengths(spark, d, rate_cube(spark, "b")), 9, *_RATES)


@query(_cube_query("nb"))
def deam_rate_cube_nb(spark, d):
    return rounded(of_lengths(spark, d, rate_cube(spark, "nb")), 9, *_RATES)


_CELL_TERMS = (("ct5", "i", "i", "ct"), ("ga3", "29 - i", "i", "ga"), ("ct3", "29 - i", "29 - i", "ct"), ("ga5", "i", "29 - i", "ga"))


def _log(p: str) -> str:
    """The logarithm of a probability; an impossible cell weighs nothing."""
    return f"CASE WHEN {p} > 0 THEN ln({p}) ELSE 0 END"


_TERM = f"w * y * {_log('(f * (1 - s) + (1 - f) * s / 3)')} + w * (1 - y) * {_log('((1 - f) * (1 - s) + f * s / 3)')}"


def _full_sql(model: str, x=X, eps: float = EPS) -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT {c} * {1 - eps}::DOUBLE AS f, e.seq_err AS s, q.scale_{k} AS w, q.freq_{k} AS y FROM avg_rates JOIN prof e ON e.idx = {err} JOIN prof q ON q.idx = {at}"
        for c, err, at, k in _CELL_TERMS
    )
    return (
        _CTE + _WIDE + _PROFILE + _HIST + ", " + _cube_sql(model, x) + f""", freq AS (SELECT length, n / (SELECT CAST(sum(n) AS DOUBLE) FROM hist) AS f FROM hist)
, avg_rates AS (SELECT n AS i, {", ".join(f"sum({c} * f) AS {c}" for c in _RATES)} FROM cube JOIN freq ON len = length GROUP BY n)
, terms AS ({parts})
SELECT round(-sum({_TERM}), 6) AS llh FROM terms"""
    )


def model_profile(spark, d):
    """What the model is fitted to: 30 rows and a length distribution, in one pass over the bases."""
    freq = OL.gap_filled(OL.length_histogram(reads(spark, d))).select("length", "freq")
    return PF.profile_of(counts(spark, d), freq)


def _full(spark, d, model):
    llh = DM.loss(X, model_profile(spark, d), model, EPS)[0]
    return rounded(spark.createDataFrame([(llh,)], "llh double"), 6, "llh")


@query(_full_sql("b"))
def full_loglike_b_fixed(spark, d):
    return _full(spark, d, "b")


@query(_full_sql("nb"))
def full_loglike_nb_fixed(spark, d):
    return _full(spark, d, "nb")


# the Hessian of the nb model in SQL: second derivatives of the weights, of the nick's share and of the rates, summed over the cells


def _hessian_sql(x=X, eps: float = EPS) -> str:
    lam, de, ds, nu = (f"{v}::DOUBLE" for v in x)
    one = lambda k: (  # noqa: E731  the weight of an overhang and its derivatives by lambda
        f"CASE WHEN {k} = 0 THEN 1 + {lam} ELSE {lam} * pow(1 - {lam}, {k}) END",
        f"CASE WHEN {k} = 0 THEN 1 ELSE pow(1 - {lam}, {k}) - {k} * {lam} * pow(1 - {lam}, {k} - 1) END",
        f"CASE WHEN {k} = 0 THEN 0 ELSE -2 * {k} * pow(1 - {lam}, {k} - 1) + {k} * ({k} - 1) * {lam} * pow(1 - {lam}, greatest({k} - 2, 0)) END",
    )
    (l0, l1, l2), (r0, r1, r2) = one("l"), one("r")
    w = (f"({l0}) * ({r0})", f"(({l1}) * ({r0}) + ({l0}) * ({r1}))", f"(({l2}) * ({r0}) + 2 * ({l1}) * ({r1}) + ({l0}) * ({r2}))")
    rest = f"(1 + (len - 2 - l - r) * {nu})"
    g = (f"{nu} / {rest}", f"1 / ({rest} * {rest})", f"-2 * (len - 2 - l - r) / ({rest} * {rest} * {rest})")
    orders = {"v": (0, 0), "a": (1, 0), "u": (0, 1), "aa": (2, 0), "au": (1, 1), "uu": (0, 2)}
    sums = ", ".join(
        f"sum(CASE WHEN l <= n AND r <= len - n - 1 THEN {w[i]} * {g[j]} * (n - l) ELSE 0 END) / 4 AS pl_{k},"
        f" sum(CASE WHEN r <= n AND l <= len - n - 1 THEN {w[i]} * {g[j]} * (len - n - 1 - l) ELSE 0 END) / 4 AS pr_{k}"
        for k, (i, j) in orders.items()
    )
    p4 = {"v": f"pow(1 - {lam}, n + 1) / 2", "a": f"-(n + 1) * pow(1 - {lam}, n) / 2", "aa": f"(n + 1) * n * pow(1 - {lam}, greatest(n - 1, 0)) / 2"}
    # double-strand weights of the signals near their own end and of the others; p4 is the single-strand one
    d1 = {k: f"(pr_{k} + {int(k == 'v')} - ({p4.get(k, '0')}) - pl_{k}) / 2" for k in orders}
    d2 = {k: f"(pl_{k} + {int(k == 'v')} - ({p4.get(k, '0')}) - pr_{k}) / 2" for k in orders}
    cols = {}
    for s, dd, single in (("near", d1, True), ("far", d2, False)):
        b = lambda k, single=single: p4.get(k, "0") if single else "0"
        cols |= {
            f"{s}_f": f"{dd['v']} * {de} + ({b('v')}) * {ds}", f"{s}_0": f"{dd['a']} * {de} + ({b('a')}) * {ds}", f"{s}_1": dd["v"], f"{s}_2": f"({b('v')}) * 1.0::DOUBLE", f"{s}_3": f"{dd['u']} * {de}",
            f"{s}_00": f"{dd['aa']} * {de} + ({b('aa')}) * {ds}", f"{s}_01": dd["a"], f"{s}_02": f"({b('a')}) * 1.0::DOUBLE", f"{s}_03": f"{dd['au']} * {de}", f"{s}_13": dd["u"], f"{s}_33": f"{dd['uu']} * {de}",
        }
    names = [k.split("_")[1] for k in cols if k.startswith("near")]
    mean = ", ".join(f"sum({k} * f) * {1 - eps}::DOUBLE AS {k}" for k in cols)
    parts = "\n  UNION ALL ".join(
        f"SELECT {', '.join(f'{s}_{k} AS d_{k}' for k in names)}, e.seq_err AS s, q.scale_{base} AS w, q.freq_{base} AS y FROM mean JOIN prof e ON e.idx = {err} JOIN prof q ON q.idx = {at}"
        for s, err, at, base in (("near", "i", "i", "ct"), ("near", "29 - i", "i", "ga"), ("far", "29 - i", "29 - i", "ct"), ("far", "i", "29 - i", "ga"))
    )
    second = lambda i, j: f"d_{i}{j}" if f"{i}{j}" in names else "0"
    rows = "\nUNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, round(-sum(CASE WHEN p > 0 THEN v * ({second(i, j)} * k / p - d_{i} * d_{j} * k * k / (p * p)) ELSE 0 END), 4) AS h FROM probs"
        for i in range(4)
        for j in range(i, 4)
    )
    return (
        _CTE + _WIDE + _PROFILE + _HIST + f""", cells AS (SELECT CAST(n AS BIGINT) AS n, CAST(len AS BIGINT) AS len, l, r
  FROM range(15) a(n), range(30, 150) b(len), range(16) c(l), range(16) e(r) WHERE l + r <= 15)
, nick AS (SELECT n, len, {sums} FROM cells GROUP BY n, len)
, rate AS (SELECT n, len, {", ".join(f"{v} AS {k}" for k, v in cols.items())} FROM nick)
, freq AS (SELECT length, n / (SELECT CAST(sum(n) AS DOUBLE) FROM hist) AS f FROM hist)
, mean AS (SELECT n AS i, {mean} FROM rate JOIN freq ON len = length GROUP BY n)
, terms AS ({parts})
, probs AS (SELECT *, d_f * (1 - s) + (1 - d_f) * s / 3 AS p, 1 - 4 * s / 3 AS k, w * y AS v FROM terms
  UNION ALL SELECT *, (1 - d_f) * (1 - s) + d_f * s / 3, -(1 - 4 * s / 3), w * (1 - y) FROM terms)
{rows}"""
    )


@query(_hessian_sql())
def full_hessian_nb_fixed(spark, d):
    h = DM.loss_hessian(X, model_profile(spark, d), "nb", EPS)
    rows = [(i, j, float(h[i, j])) for i in range(4) for j in range(i, 4)]
    return rounded(spark.createDataFrame(rows, "i int, j int, h double"), 4, "h")


# strings of alignments

_CIGAR = {
    "cigar": "concat(1 + e % 7, 'S', 20 + e % 30, 'M', 1 + e % 3, 'I', 10 + e % 11, 'M', 1 + e % 2, 'D', 5 + e % 9, 'M')",
    "md": "concat(e % 20, 'A', e % 13, '^', repeat('AC', CAST(1 + e % 2 AS INT)), e % 9, 'G', 'T', e % 5)",
}


def _strings(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("e"))
    return e.select("e", *[F.expr(v).alias(k) for k, v in _CIGAR.items()])


_STR = "WITH s AS (SELECT e, " + ", ".join(f"{v} AS {k}" for k, v in _CIGAR.items()) + " FROM (SELECT event_id AS e FROM events))\n"


@query(
    _STR + r"""SELECT e, cigar, array_to_string(list_transform(list_zip(regexp_extract_all(cigar, '(\d+)[A-Z]', 1), regexp_extract_all(cigar, '\d+([A-Z])', 1)),
  lambda x: repeat(x[2], CAST(x[1] AS INT))), '') AS ops FROM s"""
)
def cigar_expand(spark, d):
    return _strings(spark, d).select("e", "cigar", FB.cigar_expand("cigar").alias("ops"))


@query(
    _STR + """SELECT e, md, concat_ws(' ', concat('A', e % 20), CASE WHEN e % 13 > 0 THEN concat('#', e % 13) END, concat('^', 2 * (1 + e % 2)),
  concat('G', e % 9), 'T0') AS tokens FROM s"""
)
def md_tokens(spark, d):
    said = F.array_join(F.transform(FB.md_tokens("md"), lambda t: F.concat(t["bp"], t["off"].cast("string"))), " ")
    return _strings(spark, d).select("e", "md", said.alias("tokens"))


#: Alignments of three kinds: clipped with an insertion; all other operations; clipped alone.
_MIXED = {
    "cigar": "CASE CAST(read_id % 3 AS INT) WHEN 0 THEN concat('3S', length - 8, 'M5I') WHEN 1 THEN concat('2H2S10=1X5N5M3D', length - 25, 'M1P7I') ELSE concat('5S', length - 5, 'M') END",
    "md": "CASE CAST(read_id % 3 AS INT) WHEN 0 THEN concat('4A', length - 13) WHEN 1 THEN concat('10A5^CGT', length - 25) ELSE concat(length - 5, '') END",
}
#: Where the MD strings name a base, by kind.
_NAMED = "CASE CAST(read_id % 3 AS INT) WHEN 0 THEN 7 WHEN 1 THEN 12 END"


@query(
    _CTE + rf""", cycles AS (SELECT *, CASE WHEN flag & 16 <> 0 THEN n - 1 - i ELSE i END AS c FROM
  (SELECT read_id, flag, length, read_id AS e, CAST(length AS BIGINT) AS n, unnest(range(length)) AS i FROM eligible))
, codes AS (SELECT read_id, flag, length, i, n, {D.READ_BASE} AS m FROM (SELECT *, {D.REF} AS r, {D.HASH} AS h FROM cycles))
, stored AS (SELECT read_id, length, i, CASE WHEN m > 3 THEN 4 WHEN flag & 16 <> 0 THEN 3 - m ELSE m END AS b FROM codes)
, strings AS (SELECT read_id, pos, {_MIXED["cigar"]} AS cigar FROM eligible)
, ops AS (SELECT read_id, pos, CAST(unnest(regexp_extract_all(cigar, '(\d+)[MIDNSHP=X]', 1)) AS BIGINT) AS n, unnest(regexp_extract_all(cigar, '\d+([MIDNSHP=X])', 1)) AS op,
  unnest(range(len(regexp_extract_all(cigar, '\d+')))) AS k FROM strings)
, walk AS (SELECT *, sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN n ELSE 0 END AS q,
  sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n ELSE 0 END AS r FROM ops WINDOW w AS (PARTITION BY read_id ORDER BY k))
, steps AS (SELECT read_id, op, CAST(q AS BIGINT) + j AS i, CASE WHEN op IN ('M', '=', 'X') THEN pos + CAST(r AS BIGINT) + j END AS place
  FROM (SELECT *, unnest(range(n)) AS j FROM walk WHERE op IN ('M', 'I', 'S', '=', 'X')))
SELECT read_id, length, string_agg(CAST(CASE WHEN place IS NULL THEN 4 WHEN i = {_NAMED} THEN 0 ELSE b END AS VARCHAR), '' ORDER BY i) AS ref,
  string_agg(CAST(b AS VARCHAR), '' ORDER BY i) AS read, string_agg(coalesce(CAST(place AS VARCHAR), '-'), ',' ORDER BY i) AS places
FROM stored JOIN steps USING (read_id, i) GROUP BY read_id, length"""
)
def ref_reconstruct(spark, d):
    from ..operators.alignment import aligned as rebuild

    rows = aligned(spark, d).select(
        "read_id", "flag", "pos", *[F.expr(v).alias(k) for k, v in _MIXED.items()], F.array_join(F.transform("read", FB.base_letter), "").alias("seq"), "qual"
    )
    places = F.array_join(F.transform("places", lambda p: F.coalesce(p.cast("string"), F.lit("-"))), ",")
    return rebuild(rows, places=True).select("read_id", "length", F.array_join("ref", "").alias("ref"), F.array_join("read", "").alias("read"), places.alias("places"))


_CONTIG = "SELECT concat('c', {t}) AS rname, array_to_string(list_transform(range(200), lambda i: substr('ACGT', 1 + CAST(({t} * 31 + i * i * 7 + i // 3) % 4 AS INT), 1)), '') AS seq"
_FETCH = "CAST(pos % 180 AS BIGINT)"


@query(
    _CTE + ", contigs AS (" + " UNION ALL ".join(_CONTIG.format(t=t) for t in range(4)) + ") "
    f"SELECT read_id AS key, concat('c', tid) AS rname, {_FETCH} AS begin, {_FETCH} + length % 40 AS \"end\", "
    f"substr(seq, CAST({_FETCH} + 1 AS INT), length % 40 + 1) AS bases FROM eligible JOIN contigs c ON c.rname = concat('c', tid)"
)
def fasta_fetch(spark, d):
    i = F.expr("sequence(0, 199)")
    contigs = spark.range(4).select(
        F.concat(F.lit("c"), F.col("id")).alias("rname"),
        F.array_join(F.transform(i, lambda k: F.substring(F.lit("ACGT"), (1 + (F.col("id") * 31 + k * k * 7 + F.floor(k / 3)) % 4).cast("int"), F.lit(1))), "").alias("seq"),
    )
    size = 64
    chunks = contigs.select("rname", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("chunk_id"), "seq")
    chunks = chunks.withColumn("seq", F.substring("seq", (F.col("chunk_id") * size + 1).cast("int"), F.lit(size)))
    wanted = reads(spark, d).select(
        F.col("read_id").alias("key"), F.concat(F.lit("c"), F.col("tid")).alias("rname"), (F.col("pos") % 180).alias("begin"), (F.col("pos") % 180 + F.col("length") % 40).alias("end")
    )
    return OREF.fetch(wanted, chunks, size)


_BED = [("c0", 100, 20000), ("c1", 0, 1000), ("c1", 50000, 90000), ("c3", 99000, 99990)]


@query(
    _CTE + "SELECT read_id, concat('c', tid) AS rname, pos FROM eligible WHERE "
    + " OR ".join(f"(tid = {c[1]} AND pos >= {a} AND pos < {b})" for c, a, b in _BED)
)
def bed_semi_join(spark, d):
    bed = spark.createDataFrame(_BED, "chrom string, start long, end long")
    return OREF.within(reads(spark, d).select("read_id", F.concat(F.lit("c"), F.col("tid")).alias("rname"), "pos"), bed)


# scores

@query(
    _CTE + "SELECT read_id, length, round(sum(CASE WHEN qual = 255 THEN 0 WHEN ref = read THEN ln(1 - pow(10.0, -qual / 10.0)) ELSE ln(pow(10.0, -qual / 10.0) / 3) END), 6) + 0.0::DOUBLE AS ln_err "
    "FROM near GROUP BY read_id, length"
)
def error_lik(spark, d):
    return OS.native_log_error(aligned_ends(spark, d)).select("read_id", "length", (F.round("ln_err", 6) + 0.0).alias("ln_err"))


_W = _CTE + _HIST + ", " + SS.weights_sql(X, True)
_SIDES = "SELECT len, CAST({damage} AS BOOLEAN) AS damage, side, k, m, round(w, 12) + 0.0::DOUBLE AS w FROM side{tag} UNION ALL SELECT len, {damage}, side, k, -1, round(w, 12) + 0.0::DOUBLE FROM side_rest{tag} UNION ALL SELECT len, {damage}, '-', -1, -1, round(w, 12) + 0.0::DOUBLE FROM rest{tag}"


def _weight_rows(spark, d, schema: str, rows) -> DataFrame:
    """rows(length): tuples of ``schema`` for every length that reads have, made on the executors; the number of reads."""

    def run(batches):
        for batch in batches:
            for length, n_reads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = [*zip(*rows(length), strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, got), pa.array([n_reads] * len(got[0]))], [c.split()[0] for c in kinds.split(", ")])

    kinds = schema + ", n_reads long"
    return OL.length_histogram(reads(spark, d)).select(F.col("length").cast("long"), "n").mapInArrow(run, kinds)


@query(_W + "SELECT len, l, r, round(nick, 12) + 0.0::DOUBLE AS nick, round(nick_last, 12) + 0.0::DOUBLE AS nick_last, round(none, 12) + 0.0::DOUBLE AS none, hist.n AS n_reads FROM short_pair JOIN hist ON len = length")
def nick_overhang_weights(spark, d):
    def rows(n):
        w = OS.weights(X, n, 1e-8, True).both
        return [(n, a, b, *map(float, w[a, b] + 0.0)) for a in range(POSITIONS + 1) for b in range(POSITIONS + 1)]

    return rounded(_weight_rows(spark, d, "len long, l long, r long, nick double, nick_last double, none double", rows), 12, "nick", "nick_last", "none")


@query(_W + ", " + SS.weights_sql(X, False, "_no") + "SELECT s.*, hist.n AS n_reads FROM (" + _SIDES.format(damage="true", tag="") + " UNION ALL " + _SIDES.format(damage="false", tag="_no") + ") s JOIN hist ON len = length")
def nick_side_weights(spark, d):
    def rows(n):
        for damage in (True, False):
            w = OS.weights(X, n, 1e-8, damage)
            for side, table, rest in (("L", w.left, w.left_rest), ("R", w.right, w.right_rest)):
                for k in range(POSITIONS + 1):
                    yield from ((n, damage, side, k, m, float(table[k, m]) + 0.0) for m in range(k, table.shape[1]))
                    yield n, damage, side, k, -1, float(rest[k]) + 0.0
            yield n, damage, "-", -1, -1, float(w.rest)

    return rounded(_weight_rows(spark, d, "len long, damage boolean, side string, k long, m long, w double", rows), 12, "w")


def scored(spark, d, model="nb", compat=True):
    return OS.read_likelihoods(aligned_ends(spark, d).select("read_id", "flag", "length", "ref", "read", "qual"), X, Options(model=model, eps=EPS, compat=compat))


def _ancient_sql(model: str, compat: bool) -> str:
    parts = [_CTE + ", " + SS.FACES, SS.MODERN, SS.weights_sql(X, True), SS.scores_sql(X, compat, True), SS.model_sql("", model)]
    return ", ".join(parts) + "SELECT read_id, length, round(ln_err, 6) + 0.0::DOUBLE AS ln_err, round(ln(v), 6) + 0.0::DOUBLE AS ln_anc FROM value JOIN modern USING (read_id)"


def _ancient(spark, d, model, compat):
    return scored(spark, d, model, compat).select("read_id", "length", (F.round(F.ln("l_err"), 6) + 0.0).alias("ln_err"), (F.round(F.ln("l_anc"), 6) + 0.0).alias("ln_anc"))


@query(_ancient_sql("b", True))
def anc_lik(spark, d):
    return _ancient(spark, d, "b", True)


@query(_ancient_sql("b", False))
def anc_lik_corrected(spark, d):
    return _ancient(spark, d, "b", False)


@query(_ancient_sql("nb", True))
def anc_lik_nb(spark, d):
    return _ancient(spark, d, "nb", True)


@query(_ancient_sql("nb", False))
def anc_lik_nb_corrected(spark, d):
    return _ancient(spark, d, "nb", False)


def _undamaged_sql(model: str) -> str:
    parts = [_CTE + ", " + SS.FACES, SS.weights_sql(X, False), SS.scores_sql(X, False, False), SS.model_sql("", model)]
    return ", ".join(parts) + "SELECT read_id, length, round(v, 9) AS l_none FROM value"


@query(_undamaged_sql("nb"))
def no_pmd_lik(spark, d):
    return rounded(scored(spark, d).select("read_id", "length", "l_none"), 9, "l_none")


@query(_undamaged_sql("b"))
def no_pmd_lik_b(spark, d):
    return rounded(scored(spark, d, "b").select("read_id", "length", "l_none"), 9, "l_none")


def _posterior_sql() -> str:
    parts = [
        "WITH RECURSIVE " + SS.length_probability_sql("p_anc", *MIX[:2]), SS.length_probability_sql("p_mod", *MIX[2:]), _CTE.removeprefix("WITH ") + ", " + SS.FACES,
        SS.MODERN, SS.weights_sql(X, True), SS.scores_sql(X, True, True), SS.model_sql("", "nb"),
        SS.weights_sql(X, False, "_no"), SS.scores_sql(X, False, False, "_no"), SS.model_sql("_no", "nb"),
    ]
    one = lambda p: f"round(CAST(CAST(least(1, greatest(0, {p})) AS REAL) AS DOUBLE), 5)"
    keep, mix = f"{1 - EPS}::DOUBLE", f"{EPS}::DOUBLE"
    return ", ".join(parts) + f"""SELECT v.read_id, v.length, {one(f"v.v * {keep} * a.p / (v.v * {keep} * a.p + exp(ln_err) * {mix} * m.p)")} AS "AN",
  {one(f"v.v * {keep} / (v.v * {keep} + exp(ln_err) * {mix})")} AS "AO", {one("1 - n.v * exp(ln_err) / v.v")} AS "PD"
FROM value v JOIN value_no n USING (read_id) JOIN modern USING (read_id) JOIN p_anc a ON a.length = v.length JOIN p_mod m ON m.length = v.length"""


@query(_posterior_sql())
def posterior_scores(spark, d):
    o = Options(eps=EPS, isrecal=1)
    out = OS.posterior(scored(spark, d), o, MIX)
    return out.select("read_id", "length", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("AN", "AO", "PD")])


def _mixture_sql(x=MIX) -> str:
    head = "WITH RECURSIVE " + SS.length_probability_sql("p_anc", *x[:2]) + ", " + SS.length_probability_sql("p_mod", *x[2:]) + ", " + _CTE.removeprefix("WITH ")
    return (
        head + f""", l AS (SELECT length, (1 + read_id % 97) / 97.0::DOUBLE AS l_err, (1 + read_id % 89) / 89.0::DOUBLE AS l_anc FROM eligible)
SELECT round(sum(-ln(l_anc * a.p * {1 - EPS}::DOUBLE + l_err * m.p * {EPS}::DOUBLE)), 5) AS llh, count(*) AS n FROM l JOIN p_anc a USING (length) JOIN p_mod m USING (length)"""
    )


@query(_mixture_sql())
def mixture_loglike_fixed(spark, d):
    r = reads(spark, d).select("length", ((1 + F.col("read_id") % 97) / F.lit(97.0)).alias("l_err"), ((1 + F.col("read_id") % 89) / F.lit(89.0)).alias("l_anc"))
    llh, n = PM.evaluate(r, MIX, EPS)[0], r.count()
    return rounded(spark.createDataFrame([(llh, n)], "llh double, n long"), 5, "llh")


# fits; the oracles are Newton's method in SQL

_LOW, _HIGH = (f"{PF.EDGE}::DOUBLE",) * 4, (f"{1 - PF.EDGE!r}::DOUBLE",) * 4
#: Where SQL begins; the fits themselves begin with the naive model.
_BEGIN = "0.43::DOUBLE AS p0, 0.029::DOUBLE AS p1, 0.88::DOUBLE AS p2, 0.06::DOUBLE AS p3"
_NEWTON_STEPS = 20


def _fitted(df: DataFrame, names, digits: int = 5, llh: int = 6) -> DataFrame:
    cols = [f"{n}{x}" for n in names for x in ("", "_low", "_high")]
    return rounded(rounded(df, digits, *cols), llh, "llh")


def _damage_fit_sql(g: str, model: str, tag: str) -> str:
    """CTEs up to fit{tag}: a row of fitted parameters for each g of prof and freq."""
    terms = lambda at, tag: FS.damage_terms(model, EPS, at, tag)
    return (
        FS.newton(terms(f"newton{tag}_at", ""), f"newton{tag}", f"SELECT g, {_BEGIN} FROM (SELECT DISTINCT g FROM prof)", _LOW, _HIGH, _NEWTON_STEPS)
        + f", last{tag} AS (SELECT * FROM newton{tag} WHERE it = {_NEWTON_STEPS}), " + terms(f"last{tag}", tag)
        + f", fit{tag} AS (SELECT '{model}' AS model, e.g AS {g}, " + ", ".join(FS.interval(i, n, _LOW, _HIGH, "top", 5) for i, n in enumerate(PF.NAMES))
        + f", round(llh, 6) AS llh FROM ({FS.ends(_LOW, _HIGH, False, tag)}) e JOIN (SELECT g, max(max_all) AS top FROM prof GROUP BY g) m USING (g))"
    )


_RECURSIVE_CTE = "WITH RECURSIVE " + _CTE.removeprefix("WITH ")
_ALL_READS_FIT = _RECURSIVE_CTE + _WIDE + _PROFILE.replace("prof AS (", "prof_of_all AS (") + _HIST + f""", prof AS (SELECT 0 AS g, * FROM prof_of_all)
, freq AS (SELECT 0 AS g, length, n / (SELECT CAST(sum(n) AS DOUBLE) FROM hist) AS f FROM hist), {FS.CELLS}, """


@query(_ALL_READS_FIT + _damage_fit_sql("one", "b", "_b") + ", " + _damage_fit_sql("one", "nb", "_nb") + "SELECT * EXCLUDE (one) FROM fit_b UNION ALL SELECT * EXCLUDE (one) FROM fit_nb")
def fit_damage_params(spark, d):
    p = model_profile(spark, d)
    rows = [{"model": m} | PF.fit_profile(p, m, EPS).row() for m in ("b", "nb")]
    return _fitted(spark.createDataFrame(rows, "model string, " + PF.FIT_SCHEMA), PF.NAMES).drop("calls")


_TAXON_FIT = _RECURSIVE_CTE + f""", mm_of AS (SELECT taxid AS g, "end", dist, ref, read, count(*) AS n FROM near GROUP BY ALL)
, wide AS (SELECT g, "end", dist, {_CELL_SUMS} FROM mm_of GROUP BY g, "end", dist)
, part AS (SELECT g, "end", dist, CAST(CA + CC + CG + CT AS DOUBLE) AS c, CAST(GA + GC + GG + GT AS DOUBLE) AS g_all, CT, GA,
  1 - CAST(AA + TT AS DOUBLE) / (AA + AC + AG + "AT" + TA + TC + TG + TT) AS err FROM wide)
, folded AS (SELECT a.g, a.idx, freq_ct, freq_ga, scale_ct, scale_ga, seq_err FROM
  (SELECT g, CASE WHEN "end" = '5''' THEN dist ELSE 29 - dist END AS idx, CT / c AS freq_ct, c AS scale_ct, err AS seq_err FROM part) a JOIN
  (SELECT g, CASE WHEN "end" = '5''' THEN 29 - dist ELSE dist END AS idx, GA / g_all AS freq_ga, g_all AS scale_ga FROM part) b ON a.g = b.g AND a.idx = b.idx)
, prof AS (SELECT g, idx, freq_ct, freq_ga, scale_ct / m AS scale_ct, scale_ga / m AS scale_ga, seq_err, m AS max_all
  FROM (SELECT *, max(greatest(scale_ct, scale_ga)) OVER (PARTITION BY g) AS m FROM folded))
, freq AS (SELECT taxid AS g, length, count(*) / CAST(sum(count(*)) OVER (PARTITION BY taxid) AS DOUBLE) AS f FROM eligible GROUP BY taxid, length), {FS.CELLS}, """


@query(_TAXON_FIT + _damage_fit_sql("taxid", "nb", "_t") + "SELECT * EXCLUDE (model) FROM fit_t")
def fit_by_taxon(spark, d):
    lens = reads(spark, d).groupBy("taxid", "length").agg(F.count(F.lit(1)).alias("n"))
    return _fitted(PF.fit_by(counts(spark, d, "taxid"), lens, "taxid", "nb", EPS), PF.NAMES).drop("calls")


_MIX_LOW, _MIX_HIGH = tuple(f"{v}::DOUBLE" for v in PM.LOW), tuple(f"{v}::DOUBLE" for v in PM.HIGH)


def _mixture_fit_sql() -> str:
    parts = [_RECURSIVE_CTE + ", " + SS.FACES, SS.MODERN, SS.weights_sql(X, True), SS.scores_sql(X, True, True), SS.model_sql("", "nb"), FS.nodes_sql()]
    parts.append("lik AS MATERIALIZED (SELECT v.length, exp(ln_err) AS l_err, v.v AS l_anc FROM value v JOIN modern USING (read_id))")
    begin = "SELECT 0 AS g, 90::DOUBLE AS p0, 100::DOUBLE AS p1, 30::DOUBLE AS p2, 100::DOUBLE AS p3"
    parts.append(FS.newton(FS.mixture_terms(EPS, "newton_at"), "newton", begin, _MIX_LOW, _MIX_HIGH, _NEWTON_STEPS))
    parts.append(f"last AS (SELECT * FROM newton WHERE it = {_NEWTON_STEPS}), " + FS.mixture_terms(EPS, "last", "_end"))
    shown = ", ".join(FS.interval(i, n, _MIX_LOW, _MIX_HIGH, "1", 3) for i, n in enumerate(PM.NAMES))
    return ", ".join(parts) + f"SELECT {shown}, round(llh, 3) AS llh FROM ({FS.ends(_MIX_LOW, _MIX_HIGH, True, '_end')})"


@query(_mixture_fit_sql())
def fit_mixture_params(spark, d):
    f = PM.fit_mixture(scored(spark, d), EPS)
    rows = spark.createDataFrame([f.row()], ", ".join(f"{n} double, {n}_low double, {n}_high double" for n in PM.NAMES) + ", llh double, calls int, jobs int")
    return _fitted(rows, PM.NAMES, 3, 3).drop("calls", "jobs")


# derivatives at fixed parameters


def _at_x(model: str) -> str:
    return _ALL_READS_FIT + f"here AS (SELECT 0 AS g, 0 AS it, {', '.join(f'{v}::DOUBLE AS p{i}' for i, v in enumerate(X))}), " + FS.damage_terms(model, EPS, "here")


def _rows_of(sums: str, names, digits: int, *keep: str) -> str:
    """The columns ``names`` of sums as rows (keep, what, value)."""
    return "\nUNION ALL ".join(f"SELECT {''.join(k + ', ' for k in keep)}'{n}' AS what, round({n}, {digits}) + 0.0::DOUBLE AS value FROM {sums}" for n in names)


def _gradient(spark, d, model):
    g = DM.loss(X, model_profile(spark, d), model, EPS)[1]
    return rounded(spark.createDataFrame([(f"g{i}", float(v)) for i, v in enumerate(g)], "what string, value double"), 5, "value")


@query(_at_x("b") + _rows_of("sums", [f"g{i}" for i in range(4)], 5))
def full_gradient_b_fixed(spark, d):
    return _gradient(spark, d, "b")


@query(_at_x("nb") + _rows_of("sums", [f"g{i}" for i in range(4)], 5))
def full_gradient_nb_fixed(spark, d):
    return _gradient(spark, d, "nb")


@query(_at_x("b") + _rows_of("sums", [f"h{i}{j}" for i, j in FS.PAIRS], 4))
def full_hessian_b_fixed(spark, d):
    h = DM.loss_hessian(X, model_profile(spark, d), "b", EPS)
    return rounded(spark.createDataFrame([(f"h{i}{j}", float(h[i, j])) for i, j in FS.PAIRS], "what string, value double"), 4, "value")


@query(
    _CTE + _WIDE + _PROFILE + f""", c AS (SELECT lam, de, ds, idx, pow(1 - lam, idx + 1) / 2 AS s, -(idx + 1) * pow(1 - lam, idx) / 2 AS t, freq_ct, freq_ga, scale_ct, scale_ga FROM prof, {_GRID_SQL} WHERE idx < 15)
, q AS (SELECT *, scale_ct * (freq_ct / (de + s * (ds - de)) - (1 - freq_ct) / (1 - de - s * (ds - de))) AS a, scale_ga * (freq_ga / (s * ds) - (1 - freq_ga) / (1 - s * ds)) AS b FROM c)
SELECT lam, de, ds, round(-sum(a * t * (ds - de) + b * t * ds), 5) AS by_lam, round(-sum(a * (1 - s)), 5) AS by_de, round(-sum(a * s + b * s), 5) AS by_ds FROM q GROUP BY lam, de, ds"""
)
def naive_gradient_grid(spark, d):
    p = DM.Profile.of(profile(spark, d).collect(), [], [])
    rows = [(*x, *map(float, DM.naive_loss(x, p)[1])) for x in _GRID]
    return rounded(spark.createDataFrame(rows, "lam double, de double, ds double, by_lam double, by_de double, by_ds double"), 5, "by_lam", "by_de", "by_ds")


_POINTS = (MIX, (80.0, 35.0, 60.0, 45.0), (40.0, 90.0, 140.0, 16.0))


@query(
    _CTE + f", {FS.nodes_sql()}, lik AS (SELECT length, (1 + read_id % 97) / 97.0::DOUBLE AS l_err, (1 + read_id % 89) / 89.0::DOUBLE AS l_anc FROM eligible)"
    + ", here(g, it, p0, p1, p2, p3) AS (VALUES " + ", ".join(f"({k}, 0, " + ", ".join(f"{v}::DOUBLE" for v in x) + ")" for k, x in enumerate(_POINTS)) + "), "
    + FS.mixture_terms(EPS, "here") + _rows_of("sums", FS.SUMS, 4, "g AS point") + "\nUNION ALL SELECT g AS point, 'value' AS what, round(-llh, 4) AS value FROM sums"
)
def mixture_points(spark, d):
    """The length mixture's likelihood with its derivatives at several points, from one job."""
    r = reads(spark, d).select("length", ((1 + F.col("read_id") % 97) / F.lit(97.0)).alias("l_err"), ((1 + F.col("read_id") % 89) / F.lit(89.0)).alias("l_anc"))
    rows = []
    for k, p in enumerate(PM.evaluate_points(r, _POINTS, EPS)):
        rows += [(k, "value", p.value)] + [(k, f"g{i}", float(v)) for i, v in enumerate(p.gradient)] + [(k, f"h{i}{j}", float(p.hessian[i, j])) for i, j in FS.PAIRS]
    return rounded(spark.createDataFrame(rows, "point int, what string, value double"), 4, "value")


# what the sinks write

_LINE = "concat(\"end\", chr(9), dist + 1, " + ", ".join(f"chr(9), printf('%f', CAST(\"{c}\" AS DOUBLE))" for c in CELLS) + ", chr(9), printf('%f', CT / CAST(CA + CC + CG + CT AS DOUBLE)), chr(9), printf('%f', GA / CAST(GA + GC + GG + GT AS DOUBLE)))"


@query(_CTE + _WIDE + f"SELECT CAST(CASE WHEN \"end\" = '5''' THEN dist ELSE dist + 15 END AS INT) AS line, {_LINE} AS text FROM wide")
def mismatch_table_lines(spark, d):
    from ..sources.sinks import mismatch_lines

    return mismatch_lines(wide(spark, d))
