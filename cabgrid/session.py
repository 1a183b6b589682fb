"""Session settings for local runs and the shared folder for written tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# Settings every run wants; cluster-size settings (shuffle partitions, file
# split size) come from the caller.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "cabgrid",
    driver_memory: str = "8g",
    extra: dict | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
    )
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``.  Only a local-mode session without
    one (a bare test session) gets a fresh local folder, once per
    application; on a cluster a missing setting is an error, never a
    machine-local folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _LOCAL_DIRS.get(sc.applicationId)
        if base is None:
            base = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="cabgrid-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


# Paths handed out and not yet deleted, by application.
_TABLES: dict[str, list[str]] = {}


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder.

    Whatever is written there is deleted by :func:`delete_tables`, at the
    latest when the Python driver ends.
    """
    path = f"{shared_dir(spark)}/cabgrid-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _TABLES:
        atexit.register(_delete_at_exit, spark, app)
    _TABLES.setdefault(app, []).append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder with Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_tables(spark: SparkSession, since: int = 0) -> None:
    """Delete the helper tables that operators wrote for this application.

    Call it once results that read them are stored; frames built on them
    cannot be read afterwards.  ``since``: keep the first so many (see
    :func:`table_count`), to delete only what a step added.
    """
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    while len(paths) > since:
        delete_path(spark, paths.pop())


def table_count(spark: SparkSession) -> int:
    """Number of helper tables written and not deleted."""
    return len(_TABLES.get(spark.sparkContext.applicationId, []))


def _delete_at_exit(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            delete_tables(spark)
    except (Py4JError, OSError, AttributeError):
        pass  # the session is gone: its folder stays
