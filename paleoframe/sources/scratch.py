"""Names for files of this application in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, str] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to, ending with ``name``, below ``spark.checkpoint.dir``; a local folder is made
    only where that is unset and the master is local."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="paleoframe-")
        if base.startswith("file:/") and not base.startswith("file://"):
            base = base.removeprefix("file:")
        _made[app] = f"{base.rstrip('/')}/files-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _made[app])
    return f"{_made[app]}/{uuid.uuid4().hex[:12]}/{name}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
