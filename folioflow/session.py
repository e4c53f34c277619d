"""Session settings shared by the jobs, the tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that may be changed on a running session.  The number of shuffle
# partitions is left to the cluster; AQE coalesces small ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches are cut by size, not only by rows: long texts and index segments
    # would else come in batches that take several times their size in a worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # A union of two co-partitioned inputs may be joined with the wrong number
    # of partitions once AQE coalesces one side (Spark 4.1).
    "spark.sql.unionOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC days, AQE)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, app: str = "folioflow") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, named by ``spark.checkpoint.dir``.

    Where it is unset a local master gets a folder of its own, which goes with
    the process; on a cluster the setting is required, since a machine-local
    folder would lose stage files together with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    base = tempfile.mkdtemp(prefix="folioflow-", dir="/tmp")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


# Folders of the runs in progress, the innermost last.
_RUNS: list[str] = []


@contextmanager
def stage_run(spark: SparkSession) -> Iterator[str]:
    """Stage tables made within go to one folder, which is removed at the end.

    Write the result inside the block: what is only planned there would miss
    its tables later.
    """
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    _RUNS.append(folder)
    try:
        yield folder
    finally:
        _RUNS.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a stage table; never read and overwritten by one job."""
    return f"{_RUNS[-1] if _RUNS else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
