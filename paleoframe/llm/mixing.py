"""Mixing sources to target weights with DataFrame functions only.

Documents fall into cells (source, language, topic). Iterative proportional fitting rakes the token weights of the cells
until their sums over sources, languages and topics meet the targets: in turn, the cells of each category of one dimension
are scaled by what the category lacks. Rounds go on until every marginal is within ``TOLERANCE`` of its target. A document is then taken with the probability that its cell's weight asks
for, decided by a hash of its id, so that a rerun takes the same documents.

Targets are the caller's: for each dimension shares by category, or an exponent that tempers the categories' own shares
(1: as they are, 0: all equal). Probabilities are the cells' raking factors divided by the largest of them, so none is
over one and none is cut off.

What grows with the data is read in place: one pass sums tokens by cell (partial sums before the shuffle), one pass looks
up the cells. Cells are a table of one row for each combination of categories that occurs, however many documents there are;
a round is three windows over it, by source, by language and by topic, and BLOCK rounds are one plan. The table is written
between blocks, and joined broadcast only if its size is under the session's limit; to the driver come single numbers.

Defined results: a null or empty text has no tokens and its document is taken with its cell's probability; null sources,
languages and topics are categories of their own, written as ''; a category without a target has the share 0 and is not
taken; a null id hashes as ''; repeated rows are taken or left together; a cell without tokens has probability 0 unless
all have none, and then 1; an empty table gives no rows; all columns are kept, names that begin with ``__pf_`` are not for
users.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TEMPER = 0.85
#: Rounds of raking in one plan, the most rounds, and how far off its target a marginal may be, as a part of itself.
BLOCK, ROUNDS, TOLERANCE = 4, 12, 0.01
DIMS = ("source", "lang", "topic")
#: Exponents, or shares by category, for each dimension.
Targets = Mapping[str, "float | Mapping[str, float]"]
TARGETS: Targets = dict.fromkeys(DIMS, TEMPER)
#: Text contained -> topic, first match first; "general" where none is found. For corpora that have no column of topics.
TOPICS = {"License": "legal", "@": "contact", " | ": "table", "http": "web"}
CELL, TOKENS, P = (common.OWN + x for x in ("cell", "tokens", "p"))


def topic_of(text: Column) -> Column:
    out = None
    for mark, name in TOPICS.items():
        out = F.when(F.contains(text, F.lit(mark)), name) if out is None else out.when(F.contains(text, F.lit(mark)), name)
    return out.otherwise("general")


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes over four, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def keyed(docs: DataFrame, topic: Column | str | None = None) -> DataFrame:
    """``docs`` with the struct CELL of its categories and TOKENS. topic: the column that has it; else topic_of(text)."""
    topic = topic_of(F.coalesce("text", F.lit(""))) if topic is None else F.col(topic) if isinstance(topic, str) else topic
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.withColumns(
        {
            CELL: F.struct(blank(F.col("source")).alias("source"), blank(F.col("lang")).alias("lang"), blank(topic).alias("topic")),
            TOKENS: token_estimate(F.col("text")),
        }
    )


def cells_of(rows: DataFrame) -> DataFrame:
    """source, lang, topic, tokens of ``keyed`` rows."""
    return rows.groupBy(CELL).agg(F.sum(TOKENS).alias("tokens")).select(f"{CELL}.*", "tokens")


def target_shares(cells: DataFrame, dim: str, target: float | Mapping[str, float]) -> DataFrame:
    """dim, want: the categories' shares, which add up to one; null if no category has both tokens and a target."""
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    if isinstance(target, Mapping):
        if any(not v >= 0 for v in target.values()):
            raise ValueError(f"targets of {dim} are 0 or more")
        told = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, float(v))]) if target else F.create_map().cast("map<string,double>")
        raw = F.coalesce(F.try_element_at(told, F.col(dim)), F.lit(0.0))
    else:
        raw = F.pow("n", F.lit(float(target)))
    return own.select(dim, raw.alias("raw")).select(dim, F.try_divide("raw", F.sum("raw").over(Window.partitionBy())).alias("want"))


def _off(state: DataFrame) -> DataFrame:
    """dim, off: how far each marginal is off, as a part of its target."""
    out = None
    for d in DIMS:
        own = state.groupBy(d).agg(F.sum("weight").alias("sum"), F.max(f"w_{d}").alias("want"))
        own = own.select(F.lit(d).alias("dim"), F.try_divide(F.abs(F.col("sum") - F.col("want")), F.col("want")).alias("off"))
        out = own if out is None else out.unionByName(own)
    return out


def rake(cells: DataFrame, targets: Targets = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """cells: source, lang, topic, tokens. Adds weight (tokens after raking) and p (probability of a document).

    Ends after the first block of rounds with all marginals within ``tolerance``, or after ``rounds``: as where targets
    contradict cells, which is then an error (strict) or a warning that names the dimension.
    """
    cells = common.written(cells.where("tokens > 0"), "mix-cells", True)
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("tokens")).head()[0] or 0)
    for d in DIMS:
        state = state.join(target_shares(cells, d, targets[d]).select(d, (F.col("want") * total).alias(f"w_{d}")), d)
    done, off = 0, []
    while done < rounds and not (done and all(x <= tolerance for _, x in off)):
        for d in DIMS * min(BLOCK, rounds - done):
            have = F.sum("weight").over(Window.partitionBy(d))
            state = state.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"w_{d}"), have), F.lit(0.0)))
        done += min(BLOCK, rounds - done)
        state = common.written(state, "mix-state", True)
        found = _off(state).groupBy("dim").agg(F.max("off").alias("off")).collect()
        if none := sorted(r["dim"] for r in found if r["off"] is None):
            raise ValueError(f"no category of {none[0]} has both tokens and a target")
        off = [(r["dim"], r["off"]) for r in found]
    for d, x in off:
        if x > tolerance:
            said = f"raking does not meet the targets of {d}: a marginal is off by {x:.3g} of itself after {done} rounds"
            if strict:
                raise ValueError(said)
            warnings.warn(said, stacklevel=2)
    out = state.withColumn("f", F.col("weight") / F.col("tokens"))
    top = out.agg(F.max("f")).head()[0]
    return out.select(*DIMS, "tokens", "weight", (F.col("f") / F.lit(top or 1.0)).alias("p"))


def mix(docs: DataFrame, targets: Targets = TARGETS, topic: Column | str | None = None) -> DataFrame:
    """The taken rows of ``docs`` with the columns CELL, TOKENS and P."""
    rows = keyed(docs, topic)
    table = common.written(rake(cells_of(rows), targets).select(F.struct(*DIMS).alias(CELL), F.col("p").alias(P)), "mix-table")
    none = F.lit(0.0 if table.head(1) else 1.0)
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10)
    return rows.join(table, CELL, "left").withColumn(P, F.coalesce(P, none)).where(u.cast("double") / 4294967296.0 < F.col(P))


def op7_mixing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", f"{CELL}.*", F.col(TOKENS).alias("tokens"), F.round(P, 6).alias("p"))


def stage_mix(spark, docs, sf_dir):
    return mix(docs).select(*docs.columns)


def _sql() -> str:
    case = " ".join(f"WHEN contains(coalesce(text, ''), '{k}') THEN '{v}'" for k, v in TOPICS.items())
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {case} ELSE 'general' END AS topic,
  CAST(ceil(coalesce(strlen(text), 0) / 4) AS BIGINT) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    for x in DIMS:
        parts.append(
            f"t_{x} AS (SELECT {x}, s / sum(s) OVER () AS want FROM (SELECT {x}, pow(sum(tokens), {TEMPER}::DOUBLE) AS s FROM c GROUP BY {x}))"
        )
    parts.append("w0 AS (SELECT source, lang, topic, tokens, tokens AS w, sum(tokens) OVER () AS total FROM c)")
    k, ends = 0, []
    for done in range(1, ROUNDS + 1):
        for x in DIMS:
            parts.append(
                f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * want * total / sum(w) OVER (PARTITION BY {x}) AS w, total FROM w{k} JOIN t_{x} USING ({x}))"
            )
            k += 1
        if done % BLOCK == 0 or done == ROUNDS:
            off = " UNION ALL ".join(f"SELECT max(abs(s - want * total) / (want * total)) AS o FROM (SELECT {x}, sum(w) AS s, max(total) AS total FROM w{k} GROUP BY {x}) JOIN t_{x} USING ({x})" for x in DIMS)
            parts.append(f"off{k} AS (SELECT max(o) AS o FROM ({off}))")
            ends.append(k)
    # the first block after which all marginals are near enough
    choice = " ".join(f"WHEN (SELECT o FROM off{e}) <= {TOLERANCE}::DOUBLE THEN {e}" for e in ends[:-1])
    parts.append(f"chosen AS (SELECT CASE {choice} ELSE {ends[-1]} END AS k)")
    parts.append("w AS (" + " UNION ALL ".join(f"SELECT w{e}.* FROM w{e}, chosen WHERE k = {e}" for e in ends) + ")")
    parts.append("f AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS p FROM w)")
    return (
        "WITH "
        + "\n, ".join(parts)
        + """
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p FROM d JOIN f USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < p
"""
    )


OP7_SQL = _sql()
