"""Session settings and the shared working folder."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings that matter for the plans of this library on a cluster.  Partition
# counts are left to AQE: start high, let it coalesce.
CLUSTER_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "newsloom", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **CLUSTER_CONF,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_stamp() -> str:
    """Local time of a run, to the second: one literal per batch, not per row."""
    return dt.datetime.now().isoformat(sep=" ", timespec="seconds")


#: Folder of the innermost ``scratch`` block.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """Intermediate tables of the block lie in one folder, removed when the block ends.

    Results of the block must be written elsewhere inside it (``work_dir`` called before
    the block names such a folder).  After a failure the folder goes as well: a job is
    run again from its input.
    """
    folder = work_dir(spark, label)
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or under that of a ``scratch`` block.

    The cluster names that folder; it must be reachable from every executor.
    Only a local-mode session without the setting gets a temporary folder.
    """
    base = _SCRATCH.get() or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="newsloom-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
