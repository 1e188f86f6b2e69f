"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "waybill", master: str | None = None, **conf: object) -> SparkSession:
    """Return a session with the settings the library is tuned for.

    AQE coalesces and splits shuffle partitions at run time, so the partition
    count is left to the cluster's default unless the caller gives one.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the session time zone: every date rule of the library is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# The setting is fixed once a session runs, so a local session's own folder is kept here.
_own_folders: dict[str, str] = {}
# The executors that took part when a cluster's folder was tried.
_tried_by: dict[str, set[str]] = {}
# Seconds from its start in which an application's executors register; Spark's own default.
REGISTERING = 30


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its machine.  YARN brings a
    shared file system, so a folder of ``file:`` is refused there.  Other clusters may
    share a mounted one under the same path: it is taken once tasks have written to it
    and what they wrote has been read back.  Without the setting, or where it names a
    folder that each machine has for itself, as an installation's default may, they use
    the warehouse after the same trial.  A trial that only the driver's machine took part
    in shows nothing, so the executors are waited for, and the folder is tried once more
    when others have come; if they do not share it, an error says so, since what is staged
    there may lack rows, and later calls use the next folder.
    """
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if folder and (master.startswith("local") or "://" in folder and not folder.startswith("file:")):
        return folder.rstrip("/")
    if master.startswith("yarn"):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that every executor can reach, with its scheme"
        )
    application = spark.sparkContext.applicationId
    before = _own_folders.get(application)
    if master == "local" or master.startswith("local["):
        if not before:
            _own_folders[application] = tempfile.mkdtemp(prefix="waybill-")
    elif not before or _executors(spark) - _tried_by[application]:
        if not before:
            _await_executors(spark)
        _tried_by[application] = _executors(spark)
        _own_folders.pop(application, None)
        _own_folders[application] = _first_reached(spark, folder, spark.conf.get("spark.sql.warehouse.dir", None))
        if before and _own_folders[application] != before:
            raise ValueError(f"executors that came later do not share {before}, where tables are staged: set spark.checkpoint.dir to a folder that they share")
    return _own_folders[application]


def _executors(spark: SparkSession) -> set[str]:
    """Addresses of the executors registered now, and of the driver."""
    return set(spark._jsc.sc().getExecutorMemoryStatus().keys().mkString(",").split(","))


def _await_executors(spark: SparkSession) -> None:
    """Wait for the executors asked for, or until those of a new application have had time to register."""
    context, asked = spark._jsc.sc(), int(spark.conf.get("spark.executor.instances", None) or 0)
    if context.isLocal():
        return
    while time.time() < context.startTime() / 1000 + REGISTERING:
        if 0 < asked < len(_executors(spark)):
            return
        time.sleep(0.2)


def _first_reached(spark: SparkSession, *folders: str | None) -> str:
    """The first of the folders that the executors share; the error of the first if none is."""
    failed = None
    for folder in filter(None, folders):
        try:
            return _reached(spark, folder)
        except ValueError as error:
            failed = failed or error
    raise failed or ValueError("set spark.checkpoint.dir to a folder that every executor can reach")


def _reached(spark: SparkSession, folder: str) -> str:
    """The folder, if rows that the executors write to it can all be read back."""
    folder, tasks = folder.rstrip("/"), max(spark.sparkContext.defaultParallelism, len(_executors(spark)))
    top = f"{folder}/waybill-{spark.sparkContext.applicationId}"
    path = f"{top}/reached-{uuid.uuid4().hex}"
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
    except Exception as error:
        raise ValueError(f"the executors cannot use {folder}: set spark.checkpoint.dir to a folder that they share") from error
    delete_path(spark, path)
    if found != tasks:
        raise ValueError(f"{folder} is not shared by all executors: set spark.checkpoint.dir to a folder that is")
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one folder per application."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/waybill-{application}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark reaches; one that is absent is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has staged; DataFrames that read it end with it."""
    delete_path(spark, f"{shared_dir(spark)}/waybill-{spark.sparkContext.applicationId}")


# The folders staged in each scope that is open, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete on leaving what was staged inside, whether or not it ends well.

    Yields ``keep(df, label)``, which stages a result beyond the scope: what is returned
    from inside must read kept tables and the caller's own only.
    """
    own: list[str] = []
    _scopes.append(own)

    def keep(df: DataFrame, label: str = "kept") -> DataFrame:
        path = scratch_path(spark, label)
        depth = next(k for k, scope in enumerate(_scopes) if scope is own)
        if depth:
            _scopes[depth - 1].append(path)
        df.write.parquet(path)
        shared_dir(spark)  # executors may have come while it was written
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not own]
        for path in own:
            delete_path(spark, path)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The written table cuts the lineage: a lost executor re-reads files instead
    of recomputing (and possibly re-partitioning) everything before this point.
    """
    path = scratch_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    shared_dir(df.sparkSession)  # executors may have come while it was written
    return df.sparkSession.read.schema(df.schema).parquet(path)
