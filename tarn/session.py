"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tarn", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster only the time zone and adaptive execution are set here;
    partition counts and memory stay with the deployment.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Scratch folders of sessions on a local master, by application.
_LOCAL: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary folder is
    used; that needs a local master, because a machine-local path is lost with
    the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        _LOCAL[app] = tempfile.mkdtemp(prefix="tarn-scratch-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tarn-{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Tables written inside the open ``scratch`` blocks of this thread: the batches of
# several streams run in threads of their own.
_OPEN = threading.local()


def durable(df: DataFrame, outer: bool = False) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    It is computed once, survives the loss of executors, cuts the lineage, and
    later plans read only the columns they need, with known sizes. With ``outer`` it
    stays when the innermost :func:`scratch` block ends, up to the end of the next one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    blocks = getattr(_OPEN, "blocks", [])[: -1 if outer else None]
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables ``durable`` writes inside the block when it ends. For jobs
    that have stored their result by then, such as a batch of a stream."""
    blocks = _OPEN.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for path in blocks.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block the files of a job's shuffles go when it ends, not when the driver happens to
    collect its garbage. For jobs that write tables: a frame that is run twice has to shuffle anew."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
