"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts of a few kB keep a batch at a few MB; numpy code cuts batches again by size.
ARROW_ROWS = 1000

#: A small table has a file for so many rows, not one for each of the shuffle's tasks.
FILE_ROWS = 1 << 15

#: Names of columns that operators add to a user's rows for themselves begin with this.
OWN = "__pf_"

_made: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``; a local one is made only where that is unset, as in tests.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="paleoframe-")
        _made[app] = f"{base.rstrip('/')}/paleoframe-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _made[app])
    return _made[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at exit; what is left is the folder's owner's to clear
        pass


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str, small: bool = False) -> DataFrame:
    """``df``, written as a table in the shared folder and read again: cuts lineage and survives lost executors.

    small: a table of few rows, after which there are no large shuffles to release.
    """
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if not small:
        release(spark)
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` rows or fewer and whose last step is a cheap one, in as many partitions as they need."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, by: str | list[str], what: str) -> DataFrame:
    """``df``, which is dealt out by ``by`` already, as a table in as many buckets as a shuffle has partitions: joins
    on these columns then move only the other side."""
    spark = df.sparkSession
    path, name = fresh(spark, what), f"paleoframe_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *([by] if isinstance(by, str) else by)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the table is an external one
    out.written_path = path
    release(spark)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that no later plan reads."""
    remove(df.sparkSession, df.written_path)


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def cut(sizes, most: int):
    """Slices (i, j) of consecutive rows whose sizes add up to at most ``most``; a larger row stands alone."""
    sizes, i, total = list(sizes), 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(sizes):
        yield i, len(sizes)
