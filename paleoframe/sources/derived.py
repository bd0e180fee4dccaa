"""Deterministic reads, contigs and strings derived from an ``events`` table by integer arithmetic, for tests and benches.

The formulas are plain text that Spark SQL and DuckDB both read, so that every query over them has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import complement
from ..operators.reads import end_cycles
from ..schema import NO_QUALITY

#: Columns of a read from an id e; c is the cycle from the molecule's 5' end.
READ = {
    "read_id": "e",
    "taxid": "user_id % 5",
    "tid": "CAST(user_id % 4 AS INT)",
    "pos": "e * 101 % 100000",
    "mapq": "CAST(e * 7 % 61 AS INT)",
    "length": "CAST(25 + e * 37 % 140 AS INT)",
    "flag": "CAST((CASE WHEN e % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN e % 5 = 0 THEN 16 ELSE 0 END)"
    " + (CASE WHEN e % 13 = 0 THEN 256 ELSE 0 END) + (CASE WHEN e % 17 = 0 THEN 1024 ELSE 0 END) AS INT)",
}
REF = "CAST(((e * 2477 + c * 6151 + e * c * 13) % 1009) % 4 AS INT)"
HASH = "((e * 7919 + c * 104729 + e * c * 29) % 10007) % 1000"
READ_BASE = (
    "CAST(CASE WHEN h = 500 THEN 4 WHEN r = 1 AND h * (c + 1) < 250 THEN 3 WHEN r = 2 AND h * (n - c) < 250 THEN 0"
    " WHEN h >= 997 THEN (r + 1) % 4 ELSE r END AS INT)"
)
QUAL = "CAST(CASE WHEN e % 23 = 0 OR (e + c) % 41 = 0 THEN 255 ELSE 20 + (e + c * 3) % 21 END AS INT)"


def reads(events: DataFrame, key: str = "event_id", user: str = "user_id") -> DataFrame:
    """Columns of READ."""
    e = events.select(F.col(key).cast("long").alias("e"), F.col(user).cast("long").alias("user_id"))
    return e.select(*[F.expr(x).alias(c) for c, x in READ.items()])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a small file is one partition, and a read becomes many rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def with_bases(rows: DataFrame, window: int | None = None) -> DataFrame:
    """Adds ref, read and qual in the order of the forward reference (so reversed and complemented for flag 16).

    window: only so many bases of each end, which is all that ``ends`` looks at.
    """
    e, n = F.col("read_id"), F.col("length")
    cycles = F.sequence(F.lit(0), n - 1)
    if window is not None:
        cycles = F.when(n > 2 * window, F.concat(F.sequence(F.lit(0), F.lit(window - 1)), F.sequence(n - window, n - 1))).otherwise(cycles)

    def drawn(c):
        c = c.cast("long")
        r = (((e * 2477 + c * 6151 + e * c * 13) % 1009) % 4).cast("int")
        return F.struct(c.alias("c"), r.alias("r"), (((e * 7919 + c * 104729 + e * c * 29) % 10007) % 1000).alias("h"))

    def read(x):
        c, h, r = x["c"], x["h"], x["r"]
        return (
            F.when(h == 500, 4).when((r == 1) & (h * (c + 1) < 250), 3).when((r == 2) & (h * (n - c) < 250), 0).when(h >= 997, (r + 1) % 4).otherwise(r)
        ).cast("int")

    def flipped(codes):
        return F.when(rev, F.transform(codes, complement)).otherwise(codes).cast("array<int>")

    rev = F.col("flag").bitwiseAND(F.lit(16)) != 0
    base = rows.withColumn("_c", F.transform(F.when(rev, F.reverse(cycles)).otherwise(cycles), drawn))
    return base.withColumns(
        {
            "ref": flipped(F.transform("_c", lambda x: x["r"])),
            "read": flipped(F.transform("_c", read)),
            "qual": F.transform("_c", lambda x: F.when((e % 23 == 0) | ((e + x["c"]) % 41 == 0), NO_QUALITY).otherwise(20 + (e + x["c"] * 3) % 21).cast("int")),
        }
    ).drop("_c")


def stored_bases(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each base near an end that has a code, as with_bases stores them: keep, flag, length, cycle, ref, read,
    qual."""
    rev = F.col("flag").bitwiseAND(F.lit(16)) != 0
    out = rows.select(F.col("read_id").alias("e"), *keep, "flag", "length", F.col("length").cast("long").alias("n"), end_cycles().alias("i"))
    out = out.withColumns({"c": F.col("i").cast("long")}).withColumns({"r": F.expr(REF), "h": F.expr(HASH), "qual": F.expr(QUAL)})
    out = out.where("h <> 500").withColumn("a", F.expr(READ_BASE))
    turn = F.when(rev, 3).otherwise(0)
    cycle = F.when(rev, F.col("length") - 1 - F.col("i")).otherwise(F.col("i"))
    return out.select(F.col("e").alias("read_id"), *[k for k in keep if k != "read_id"], "flag", "length", cycle.alias("cycle"), *[F.abs(turn - F.col(k)).alias(c) for c, k in (("ref", "r"), ("read", "a"))], "qual")


READS_SQL = "SELECT " + ", ".join(f"{x} AS {c}" for c, x in READ.items()) + " FROM (SELECT event_id AS e, user_id FROM events)"
ELIGIBLE_SQL = "SELECT * FROM reads WHERE flag & 1 = 0 AND flag <= 256 AND length >= 30 AND length < 150"
#: Per end base, from the 5' end: dist5, dist3, ref, read, qual.
BASES_SQL = f"""SELECT read_id, taxid, flag, mapq, length, CAST(c AS INT) AS dist5, CAST(n - 1 - c AS INT) AS dist3, r AS ref, {READ_BASE} AS read, q AS qual
FROM (SELECT *, {REF} AS r, {HASH} AS h, {QUAL} AS q FROM (
  SELECT *, read_id AS e, CAST(length AS BIGINT) AS n, unnest(list_concat(range(0, 15), range(length - 15, length))) AS c FROM eligible))"""
