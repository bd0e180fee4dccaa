"""Likelihoods of reads in SQL, for the queries' oracles: nothing here is used by the scoring kernel.

The sums over overhangs and nicks are joins: weights by length, products of an end by overhang and nick. Placeholders
are filled in by ``weights_sql`` and ``scores_sql``; the tables ``reads`` and ``eligible`` come before.
"""

from __future__ import annotations

from ..schema import POSITIONS as N
from ..sources.derived import BASES_SQL

TOL = "1e-8::DOUBLE"
HIGH, LOW = "(1 - 1e-8::DOUBLE)", "1e-8::DOUBLE"


def weights_sql(x, damage: bool, tag: str = "") -> str:
    """CTEs short_pair{tag}(len, l, r, nick, nick_last, none), side{tag}(len, side, k, m, w), side_rest{tag}(len, side, k, w) and
    rest{tag}(len, w). side L: left overhang k short, the right one long; side R: the other way round."""
    lam, nu = f"{x[0]}::DOUBLE", f"{x[3]}::DOUBLE"
    first = N if damage else N - 1
    end_left = f"m = len - far - 1 AND {damage}"
    return f"""lens{tag} AS (SELECT CAST(len AS BIGINT) AS len, pow(1 - {lam}, len - 1) AS q FROM range(30, 150) t(len))
, over{tag} AS (SELECT len, k, 0.5::DOUBLE * {lam} * pow(1 - {lam}, k) / (1 - q) + CASE WHEN k = 0 THEN 0.5::DOUBLE ELSE 0 END AS p,
  3 + (1 - q - (len - 1) * {lam} * q) / pow(1 - q, 2) AS z FROM lens{tag}, (SELECT unnest(range(149)) AS k) WHERE k <= len - 2)
, pair{tag} AS (SELECT a.len, a.k AS a, b.k AS b, 4 * a.p * b.p / a.z AS dp, 1 + (a.len - a.k - b.k - 2) * {nu} AS d
  FROM over{tag} a JOIN over{tag} b ON a.len = b.len AND a.k <= {N} AND (b.k <= {N} OR b.k <= a.len - 2 - a.k))
, near_pair{tag} AS (SELECT *, {nu} / d AS v, CASE WHEN b <= {first} THEN (1 - {nu}) / d ELSE 0 END AS last FROM pair{tag} WHERE b <= {N})
, short_pair{tag} AS (SELECT len, a AS l, b AS r, CASE WHEN dp > {TOL} THEN dp ELSE 0 END AS dp0, dp0 * v AS nick, dp0 * last AS nick_last,
  dp0 * (1 - ({N} - a) * v - greatest(0, {first} - b) * v - last) AS none FROM near_pair{tag})
, far_pair{tag} AS (SELECT len, a, b AS far, dp, d, side, CASE WHEN CASE WHEN side = 'L' THEN dp >= {TOL} ELSE dp > {TOL} END THEN dp ELSE 0 END AS dp0
  FROM pair{tag}, (VALUES ('L'), ('R')) s(side) WHERE b > {N})
, nicks{tag} AS (SELECT f.*, m, CASE WHEN m > len - far - 1 THEN 0 WHEN (side = 'R' AND m = a) OR (side = 'L' AND {end_left}) THEN (1 - {nu}) / d ELSE {nu} / d END AS v
  FROM far_pair{tag} f, range({N + 1}) t(m) WHERE m >= a AND (side = 'R' OR m < {N}))
, zero{tag} AS (SELECT len, side, CAST(a AS BIGINT) AS a FROM lens{tag}, (VALUES ('L'), ('R')) s(side), range({N + 1}) t(a))
, nicks_or_none{tag} AS (SELECT len, side, a, m, dp0, v FROM nicks{tag} UNION ALL SELECT len, side, a, m, 0, 0 FROM zero{tag}, range({N + 1}) t(m) WHERE m >= a AND (side = 'R' OR m < {N}))
, side{tag} AS (SELECT len, side, a AS k, CAST(m AS BIGINT) AS m, sum(dp0 * v) AS w FROM nicks_or_none{tag} GROUP BY ALL)
, side_rest{tag} AS (SELECT len, side, a AS k, sum(dp0 * (1 - used)) AS w FROM (
  SELECT f.len, f.side, f.a, dp0, coalesce(used, 0) AS used FROM far_pair{tag} f
  LEFT JOIN (SELECT len, side, a, far, sum(v) AS used FROM nicks{tag} GROUP BY ALL) u ON f.len = u.len AND f.side = u.side AND f.a = u.a AND f.far = u.far
  UNION ALL SELECT len, side, a, 0, 0 FROM zero{tag}) GROUP BY ALL)
, rest{tag} AS (SELECT len, CASE WHEN 1 - s > {TOL} THEN 1 - s ELSE 0 END AS w FROM
  (SELECT len, sum(CASE WHEN b <= {N} THEN dp ELSE 2 * dp END) AS s FROM pair{tag} GROUP BY len))
"""


#: Ends of each read as the kernel sees them: on its own strand, and (turned) on the other one.
FACES = f"""raw AS ({BASES_SQL})
, faces AS (SELECT read_id, length, false AS turned, 'L' AS side, dist5 AS i, ref, read, qual FROM raw WHERE dist5 < {N}
  UNION ALL SELECT read_id, length, false, 'R', dist3, ref, read, qual FROM raw WHERE dist3 < {N}
  UNION ALL SELECT read_id, length, true, 'L', dist3, CASE WHEN ref < 4 THEN 3 - ref ELSE 4 END, CASE WHEN read < 4 THEN 3 - read ELSE 4 END, qual FROM raw WHERE dist3 < {N}
  UNION ALL SELECT read_id, length, true, 'R', dist5, CASE WHEN ref < 4 THEN 3 - ref ELSE 4 END, CASE WHEN read < 4 THEN 3 - read ELSE 4 END, qual FROM raw WHERE dist5 < {N})
"""


def _factor(rate: float, base: int, to: int, other: str = f"least(e3, {HIGH})") -> str:
    d = f"({rate}::DOUBLE * (1 - 4 * e3))"
    return (
        f"CASE WHEN ref > 3 OR read > 3 OR qual = 255 THEN 0 ELSE ln(CASE WHEN ref = {base} AND read = {base} THEN greatest(1 - 3 * e3 - {d}, {LOW})"
        f" WHEN ref = {base} AND read = {to} THEN least(e3 + {d}, {HIGH}) WHEN ref = read THEN greatest(1 - 3 * e3, {LOW}) ELSE {other} END) END"
    )


def scores_sql(x, compat: bool, damage: bool, tag: str = "") -> str:
    """CTE score{tag}(read_id, length, turned, v): the ancient likelihood (damage) or the probability of no damage."""
    d, ds = x[1], x[2]
    C, G = (1, 3), (2, 0)
    if damage:
        odd = "turned AND NOT (ref = 1 AND read = 3) AND NOT (ref = 2 AND read = 0)" if compat else "false"
        least = f"CASE WHEN {odd} THEN least(e3, {LOW}) ELSE least(e3, {HIGH}) END"
        side = lambda left, right: f"CASE WHEN side = 'L' THEN {left} ELSE {right} END"
        cols = {
            "s": side(_factor(ds, *C), _factor(ds, *G)), "b": side(_factor(d, *C), _factor(d, *G)), "a": side(_factor(d, *G), _factor(d, *C)),
            "ws": _factor(ds, *C, least), "wb": _factor(d, *C, least),
        }
        full = f"CASE WHEN NOT turned AND side = 'L' AND ref = 1 AND read = 3 AND qual <> 255 THEN ln(least(e3 + {ds}::DOUBLE, {HIGH})) ELSE {cols['s']} END"
        cols["alone"] = full if compat else cols["s"]
        first = N
    else:
        own = lambda left, right, r: f"CASE WHEN ref = CASE WHEN side = 'L' THEN {left} ELSE {right} END THEN ln(1 - {r}::DOUBLE) ELSE 0 END"
        cols = {"s": own(1, 2, ds), "b": own(1, 2, d), "a": own(2, 1, d)}
        cols |= {"ws": cols["s"], "wb": cols["b"], "alone": cols["s"]}
        first = N - 1
    lists = ", ".join(f"list({v} ORDER BY i) AS {k}" for k, v in cols.items())
    pre = ", ".join(f"coalesce(list_sum({c}[1:k]), 0) AS {c}, list_sum({c}) AS {c}_all" for c in cols)
    return f"""ends{tag} AS (SELECT read_id, length, turned, side, {lists} FROM (SELECT *, pow(10.0, -qual / 10.0) / 3 AS e3 FROM faces) GROUP BY ALL)
, pre{tag} AS (SELECT read_id, length, turned, side, k, {pre} FROM ends{tag}, range({N + 1}) t(k))
, nicked{tag} AS (SELECT p.read_id, p.length, p.turned, p.side, p.k, m, exp(p.s + c.b - p.b + p.a_all - c.a) AS v
  FROM pre{tag} p, range({N + 1}) t(m) JOIN pre{tag} c ON c.k = least(m + 1, {N}) AND c.read_id = p.read_id AND c.turned = p.turned AND c.side = p.side
  WHERE m >= p.k AND (p.side = 'R' OR m < {N}))
, nick_sums{tag} AS (SELECT read_id, turned, n.side, n.k, sum(CASE WHEN n.side = 'L' OR (n.m > n.k AND n.m <= {first}) THEN v ELSE 0 END) AS inside,
  sum(CASE WHEN n.m = n.k THEN v ELSE 0 END) AS at_last, sum(v * w) AS far
  FROM nicked{tag} n JOIN side{tag} w ON w.len = n.length AND w.side = n.side AND w.k = n.k AND w.m = n.m GROUP BY ALL)
, by_overhang{tag} AS (SELECT p.read_id, p.length, p.turned, p.side, p.k, exp(p.s + p.b_all - p.b) AS free, exp(p.ws + p.wb_all - p.wb) AS wfree,
  coalesce(n.inside, 0) AS inside, coalesce(n.at_last, 0) AS at_last, coalesce(n.far, 0) + exp(p.s + p.b_all - p.b) * r.w AS far
  FROM pre{tag} p JOIN side_rest{tag} r ON r.len = p.length AND r.side = p.side AND r.k = p.k
  LEFT JOIN nick_sums{tag} n ON n.read_id = p.read_id AND n.turned = p.turned AND n.side = p.side AND n.k = p.k)
, whole{tag} AS (SELECT read_id, length, turned, sum(CASE WHEN side = 'L' THEN s_all END) AS l, sum(CASE WHEN side = 'R' THEN s_all END) AS r,
  sum(CASE WHEN side = 'L' THEN alone_all END) AS alone FROM pre{tag} WHERE k = 0 GROUP BY ALL)
, short{tag} AS (SELECT l.read_id, l.turned, sum(l.inside * r.free * w.nick + l.wfree * r.inside * w.nick + l.wfree * r.at_last * w.nick_last + l.free * r.free * w.none) AS v
  FROM by_overhang{tag} l JOIN by_overhang{tag} r ON l.side = 'L' AND r.side = 'R' AND l.read_id = r.read_id AND l.turned = r.turned
  JOIN short_pair{tag} w ON w.len = l.length AND w.l = l.k AND w.r = r.k GROUP BY ALL)
, long{tag} AS (SELECT read_id, turned, sum(CASE WHEN side = 'L' THEN far END) AS l, sum(CASE WHEN side = 'R' THEN far END) AS r FROM by_overhang{tag} GROUP BY ALL)
, score{tag} AS (SELECT w.read_id, w.length, w.turned, s.v + exp(w.r) * g.l + exp(w.l) * g.r + exp(w.alone) * exp(w.r) * z.w AS v
  FROM whole{tag} w JOIN short{tag} s ON s.read_id = w.read_id AND s.turned = w.turned JOIN long{tag} g ON g.read_id = w.read_id AND g.turned = w.turned
  JOIN rest{tag} z ON z.len = w.length)
"""


#: The modern likelihood by read.
MODERN = """modern AS (SELECT read_id, sum(CASE WHEN ref > 3 OR read > 3 OR qual = 255 THEN 0 WHEN ref = read THEN ln(1 - pow(10.0, -qual / 10.0)) ELSE ln(pow(10.0, -qual / 10.0) / 3) END) AS ln_err
  FROM faces WHERE NOT turned GROUP BY read_id)
"""


def model_sql(tag: str, model: str) -> str:
    """CTE of the model's value by read: of its own strand, or the mean of both."""
    return f"value{tag} AS (SELECT read_id, length, avg(v) AS v FROM score{tag} WHERE {'NOT turned' if model == 'b' else 'true'} GROUP BY ALL)\n"


def length_probability_sql(name: str, mu: float, sigma: float) -> str:
    """CTE name(length, p): a normal distribution cut to lengths 30 to 149, by the series of erf with positive terms only;
    the query has to begin with WITH RECURSIVE."""
    return f"""{name}_series AS (SELECT k, (k - 0.5::DOUBLE - {mu}::DOUBLE) / {sigma}::DOUBLE / sqrt(2::DOUBLE) AS x, 0 AS n, x AS term, x AS total FROM range(30, 151) t(k)
  UNION ALL SELECT k, x, n + 1, term * 2 * x * x / (2 * n + 3), total + term * 2 * x * x / (2 * n + 3) FROM {name}_series WHERE n < 150)
, {name}_cdf AS (SELECT k, 0.5::DOUBLE + total * exp(-x * x) / sqrt(pi()) AS c FROM {name}_series WHERE n = 150)
, {name} AS (SELECT a.k AS length, (b.c - a.c) / (SELECT max(c) - min(c) FROM {name}_cdf) AS p FROM {name}_cdf a JOIN {name}_cdf b ON b.k = a.k + 1)
"""
