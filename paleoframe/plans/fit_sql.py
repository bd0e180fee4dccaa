"""Newton's method in SQL, for the oracles of the fits: nothing here is used by a fit.

A relation ``at`` (g, it, p0, p1, p2, p3) holds a parameter vector for each group g. ``damage_terms`` and ``mixture_terms``
give CTEs that end in sums(g, it, p0.., llh, g0.., h00..): the log-likelihood, and the gradient and Hessian of its negative.
``newton`` repeats them in a recursive CTE with parameters at a bound held there, and ``ends`` adds the inverse Hessian.
"""

from __future__ import annotations

PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_X = "p0, p1, p2, p3"
SUMS = [f"g{i}" for i in range(4)] + [f"h{i}{j}" for i, j in PAIRS]


def _overhang(k: str) -> tuple[str, str, str]:
    """The weight of an overhang of k bases and its derivatives by lambda, p0."""
    return (
        f"CASE WHEN {k} = 0 THEN 1 + p0 ELSE p0 * pow(1 - p0, {k}) END",
        f"CASE WHEN {k} = 0 THEN 1 ELSE pow(1 - p0, {k}) - {k} * p0 * pow(1 - p0, {k} - 1) END",
        f"CASE WHEN {k} = 0 THEN 0 ELSE -2 * {k} * pow(1 - p0, {k} - 1) + {k} * ({k} - 1) * p0 * pow(1 - p0, greatest({k} - 2, 0)) END",
    )


#: Positions with overhangs, and lengths, that are summed over. No overhang of these reaches the other end, as lengths are at
#: least twice the positions.
CELLS = """cells AS MATERIALIZED (SELECT CAST(n AS BIGINT) AS n, l, r FROM range(15) a(n), range(16) c(l), range(16) e(r) WHERE l + r <= 15)
, lens AS MATERIALIZED (SELECT CAST(len AS BIGINT) AS len FROM range(30, 150) b(len))"""


def damage_terms(model: str, eps: float, at: str, tag: str = "") -> str:
    """From cells, prof(g, idx, ...) and freq(g, length, f)."""
    (l0, l1, l2), (r0, r1, r2) = _overhang("l"), _overhang("r")
    w = (f"({l0}) * ({r0})", f"(({l1}) * ({r0}) + ({l0}) * ({r1}))", f"(({l2}) * ({r0}) + 2 * ({l1}) * ({r1}) + ({l0}) * ({r2}))")
    rest = "(1 + (len - 2 - t) * p3)"
    nick = (f"p3 / {rest}", f"1 / ({rest} * {rest})", f"-2 * (len - 2 - t) / ({rest} * {rest} * {rest})")
    orders = {"v": (0, 0), "a": (1, 0), "u": (0, 1), "aa": (2, 0), "au": (1, 1), "uu": (0, 2)}
    by_both = ", ".join(
        f"sum(CASE WHEN l <= n THEN {v} * (n - l) ELSE 0 END) AS a{i}, sum(CASE WHEN r <= n THEN {v} ELSE 0 END) AS b{i}, sum(CASE WHEN r <= n THEN {v} * l ELSE 0 END) AS c{i}"
        for i, v in enumerate(w)
    )
    sums = ", ".join(f"sum(a{i} * {nick[j]}) / 4 AS pl_{k}, sum(((len - n - 1) * b{i} - c{i}) * {nick[j]}) / 4 AS pr_{k}" for k, (i, j) in orders.items())
    p4 = {"v": "pow(1 - p0, n + 1) / 2", "a": "-(n + 1) * pow(1 - p0, n) / 2", "aa": "(n + 1) * n * pow(1 - p0, greatest(n - 1, 0)) / 2"}
    single = lambda k: f"({p4.get(k, '0')})"
    left, right = ({k: f"({int(k == 'v')} - {single(k)} - {s}_{k})" for k in orders} for s in ("pl", "pr"))
    own = lambda s: {k: f"{s}_{k}" for k in orders}
    half = lambda x, y: {k: f"(({x[k]} + {y[k]}) / 2)" for k in orders}
    if model == "b":
        double = {"ct5": left, "ga3": own("pr"), "ct3": right, "ga5": own("pl")}
    else:
        one, two = half(own("pr"), left), half(own("pl"), right)
        double = {"ct5": one, "ga3": one, "ct3": two, "ga5": two}
    cols = {}
    for s, d in double.items():
        b = (lambda k: single(k)) if s in ("ct5", "ga3") else (lambda k: "0")
        cols |= {
            f"{s}_f": f"{d['v']} * p1 + {b('v')} * p2", f"{s}_0": f"{d['a']} * p1 + {b('a')} * p2", f"{s}_1": d["v"], f"{s}_2": f"{b('v')} * 1.0::DOUBLE", f"{s}_3": f"{d['u']} * p1",
            f"{s}_00": f"{d['aa']} * p1 + {b('aa')} * p2", f"{s}_01": d["a"], f"{s}_02": f"{b('a')} * 1.0::DOUBLE", f"{s}_03": f"{d['au']} * p1", f"{s}_13": d["u"], f"{s}_33": f"{d['uu']} * p1",
        }
    names = [k.split("_")[1] for k in cols if k.startswith("ct5")]
    mean = ", ".join(f"sum({k} * f) * {1 - eps}::DOUBLE AS {k}" for k in cols)
    parts = "\n  UNION ALL ".join(
        f"SELECT m.g, it, {_X}, {', '.join(f'{s}_{k} AS d_{k}' for k in names)}, e.seq_err AS s, q.scale_{base} AS w, q.freq_{base} AS y"
        f" FROM mean{tag} m JOIN prof e ON e.g = m.g AND e.idx = {err} JOIN prof q ON q.g = m.g AND q.idx = {where}"
        for s, err, where, base in (("ct5", "i", "i", "ct"), ("ga3", "29 - i", "i", "ga"), ("ct3", "29 - i", "29 - i", "ct"), ("ga5", "i", "29 - i", "ga"))
    )
    second = lambda i, j: f"d_{i}{j}" if f"{i}{j}" in names else "0"
    sure = lambda v: f"sum(CASE WHEN p > 0 THEN {v} ELSE 0 END)"
    out = [f"{sure('v * ln(p)')} AS llh"] + [f"-{sure(f'v * d_{i} * k / p')} AS g{i}" for i in range(4)]
    out += [f"-{sure(f'v * ({second(i, j)} * k / p - d_{i} * d_{j} * k * k / (p * p))')} AS h{i}{j}" for i, j in PAIRS]
    return f"""joined{tag} AS (SELECT g, it, {_X}, n, l + r AS t, {by_both} FROM cells, {at} GROUP BY g, it, {_X}, n, l + r)
, nick{tag} AS (SELECT g, it, {_X}, n, len, {sums} FROM joined{tag}, lens GROUP BY g, it, {_X}, n, len)
, rate{tag} AS (SELECT g, it, {_X}, n, len, {", ".join(f"{v} AS {k}" for k, v in cols.items())} FROM nick{tag})
, mean{tag} AS (SELECT x.g, it, {_X}, n AS i, {mean} FROM rate{tag} x JOIN freq ON freq.g = x.g AND len = length GROUP BY x.g, it, {_X}, n)
, terms{tag} AS ({parts})
, probs{tag} AS (SELECT *, d_f * (1 - s) + (1 - d_f) * s / 3 AS p, 1 - 4 * s / 3 AS k, w * y AS v FROM terms{tag}
  UNION ALL SELECT *, (1 - d_f) * (1 - s) + d_f * s / 3, -(1 - 4 * s / 3), w * (1 - y) FROM terms{tag})
, sums{tag} AS (SELECT g, it, {_X}, {", ".join(out)} FROM probs{tag} GROUP BY g, it, {_X})"""


def nodes_sql() -> str:
    """CTE nodes(t, w): Gauss-Legendre nodes in (-1/2, 1/2) and their weights."""
    from numpy.polynomial.legendre import leggauss

    return "nodes(t, w) AS (VALUES " + ", ".join(f"({float(t) / 2!r}::DOUBLE, {float(w) / 2!r}::DOUBLE)" for t, w in zip(*leggauss(10), strict=True)) + ")"


def _component(c: str, mu: str, sigma: str, share: float, tag: str, at: str) -> str:
    """CTE {c}{tag}(g, it, length, v0 .. v5): share times a normal cut to [30, 150) and its derivatives as in length_derivatives."""
    density = lambda z: f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi())"
    edge = lambda z: {"m": f"-{density(z)} / s", "s": f"-{density(z)} * ({z}) / s", "mm": f"-{density(z)} * ({z}) / (s * s)",
                      "ss": f"{density(z)} * ({z}) * (2 - ({z}) * ({z})) / (s * s)", "ms": f"{density(z)} * (1 - ({z}) * ({z})) / (s * s)"}
    a, b = edge("(length - 0.5::DOUBLE - mu) / s"), edge("(length + 0.5::DOUBLE - mu) / s")
    d = ", ".join(f"{b[k]} - ({a[k]}) AS d{k}" for k in a)
    over = "OVER (PARTITION BY g, it)"
    w = ", ".join(f"sum(d{k}) {over} / whole AS w{k}" for k in a)
    mass = f"SELECT g, it, {mu} AS mu, {sigma} AS s, length, sum(w * {density(f'(length + t - {mu}) / {sigma}')}) / {sigma} AS part FROM {at}, (SELECT CAST(unnest(range(30, 150)) AS INT) AS length), nodes GROUP BY g, it, {mu}, {sigma}, length"
    return f"""{c}{tag} AS (SELECT g, it, length, {share} * x AS v0, {share} * m AS v1, {share} * sg AS v2,
  {share} * (dmm / whole - 2 * m * wm - x * wmm) AS v3, {share} * (dss / whole - 2 * sg * ws - x * wss) AS v4, {share} * (dms / whole - m * ws - sg * wm - x * wms) AS v5
  FROM (SELECT *, dm / whole - x * wm AS m, ds / whole - x * ws AS sg FROM (SELECT *, part / whole AS x, {w} FROM (SELECT *, sum(part) {over} AS whole, {d} FROM ({mass})))))"""


def mixture_terms(eps: float, at: str, tag: str = "") -> str:
    """From lik(length, l_err, l_anc) and nodes; one group."""
    d = {0: "l_anc * a.v1", 1: "l_anc * a.v2", 2: "l_err * m.v1", 3: "l_err * m.v2"}
    own = {(0, 0): "l_anc * a.v3", (1, 1): "l_anc * a.v4", (0, 1): "l_anc * a.v5", (2, 2): "l_err * m.v3", (3, 3): "l_err * m.v4", (2, 3): "l_err * m.v5"}
    cols = ", ".join([f"{v} AS d{i}" for i, v in d.items()] + [f"{v} AS o{i}{j}" for (i, j), v in own.items()])
    out = ["sum(ln(q)) AS llh"] + [f"sum(-d{i} / q) AS g{i}" for i in range(4)]
    out += [f"sum(d{i} * d{j} / (q * q){f' - o{i}{j} / q' if (i, j) in own else ''}) AS h{i}{j}" for i, j in PAIRS]
    return f"""{_component("anc", "p0", "p1", 1 - eps, tag, at)}
, {_component("modn", "p2", "p3", eps, tag, at)}
, dens{tag} AS (SELECT a.g, a.it, l_anc * a.v0 + l_err * m.v0 AS q, {cols} FROM lik JOIN anc{tag} a USING (length) JOIN modn{tag} m ON m.length = lik.length AND m.g = a.g AND m.it = a.it)
, sums{tag} AS (SELECT t.*, {_X} FROM (SELECT g, it, {", ".join(out)} FROM dens{tag} GROUP BY g, it) t JOIN {at} x ON x.g = t.g AND x.it = t.it)"""


def _free(low, high, damping: str = "0") -> str:
    """Columns u0.. and f00..: gradient and Hessian with the parameters that are held at a bound taken out, and x0.., which are
    those. damping: the share of its diagonal that is added to the Hessian."""
    held = [f"(p{i} <= {low[i]} AND g{i} > 0 OR p{i} >= {high[i]} AND g{i} < 0) AS x{i}" for i in range(4)]
    u = [f"CASE WHEN x{i} THEN 0 ELSE g{i} END AS u{i}" for i in range(4)]
    f = [f"CASE WHEN x{i} OR x{j} THEN {float(i == j)}::DOUBLE ELSE h{i}{j}{f' + {damping} * abs(h{i}{j})' if i == j else ''} END AS f{i}{j}" for i, j in PAIRS]
    return ", ".join(held + u + f)


#: L D L' of f, then the inverse: columns i00.. .
_INVERSE = """f00 AS e0, f01 / e0 AS l10, f02 / e0 AS l20, f03 / e0 AS l30, f11 - l10 * l10 * e0 AS e1, (f12 - l20 * l10 * e0) / e1 AS l21, (f13 - l30 * l10 * e0) / e1 AS l31,
  f22 - l20 * l20 * e0 - l21 * l21 * e1 AS e2, (f23 - l30 * l20 * e0 - l31 * l21 * e1) / e2 AS l32, f33 - l30 * l30 * e0 - l31 * l31 * e1 - l32 * l32 * e2 AS e3,
  -l10 AS m10, -l21 AS m21, -l32 AS m32, l21 * l10 - l20 AS m20, l32 * l21 - l31 AS m31, l31 * l10 + l32 * l20 - l30 - l32 * l21 * l10 AS m30, """ + ", ".join(
    " + ".join(f"{f'm{k}{i}' if k > i else '1'} * {f'm{k}{j}' if k > j else '1'} / e{k}" for k in range(j, 4)) + f" AS i{i}{j}" for i, j in PAIRS
)


#: Of the step from ``at`` of number it: the first steps are short.
DAMPING = "100 * pow(0.2::DOUBLE, it)"


def newton(terms: str, name: str, start: str, low, high, steps: int) -> str:
    """CTE {name}: at of all steps. terms: CTEs that read ``{name}_at`` and end in sums; start: a query of g, p0 .. p3."""
    inv = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    moved = ", ".join(f"least({high[i]}, greatest({low[i]}, p{i} - ({' + '.join(f'{inv(i, j)} * u{j}' for j in range(4))})))::DOUBLE AS p{i}" for i in range(4))
    return f"""{name}(g, it, {_X}) AS (SELECT g, 0, {_X} FROM ({start})
UNION ALL SELECT g, it + 1, {moved} FROM (WITH {name}_at AS (SELECT * FROM {name} WHERE it < {steps}), {terms}
  SELECT *, {_INVERSE} FROM (SELECT *, {_free(low, high, DAMPING)} FROM sums)))"""


def ends(low, high, held: bool, tag: str) -> str:
    """Query of the sums and the inverse Hessian's diagonal i00, i11, i22, i33. held: with parameters at a bound taken out."""
    every = ", ".join(f"h{i}{j} AS f{i}{j}" for i, j in PAIRS)
    return f"SELECT *, {_INVERSE} FROM (SELECT *, {_free(low, high) if held else every} FROM sums{tag})"


def interval(i: int, n: str, low, high, scale: str = "1", digits: int = 4) -> str:
    """Columns n, n_low, n_high of parameter i: null at a bound, or where there is no variance."""
    at = f"p{i} <= {low[i]} OR p{i} >= {high[i]} OR i{i}{i} < 0"
    half = f"1.96 * sqrt(abs(i{i}{i}) / {scale})"
    return f'round(p{i}, {digits}) AS "{n}", CASE WHEN {at} THEN NULL ELSE round(p{i} - {half}, {digits}) END AS "{n}_low", CASE WHEN {at} THEN NULL ELSE round(p{i} + {half}, {digits}) END AS "{n}_high"'
