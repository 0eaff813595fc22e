"""Tables that a query writes on its way, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset, one in the warehouse."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/aerolith_tables"


def _held(spark: SparkSession) -> dict[str, tuple]:
    """The tables that this session's context has written and not removed: path -> file system and path in the JVM, and a weak
    reference to what every plan that reads the table holds (None: not read as a table).

    They go when no plan reads them any more (see swept), at the latest when the context stops; the file system removes what is
    left when the JVM ends.
    """
    sc = spark.sparkContext
    if "_aerolith_tables" not in sc.__dict__:
        tables, stop = {}, sc.stop

        def stop_after_removing() -> None:
            with contextlib.suppress(Exception):  # whatever the file system says, the context stops
                for path in list(tables):
                    _delete(tables, path)
            stop()

        sc._aerolith_tables, sc.stop = tables, stop_after_removing
    return sc._aerolith_tables


def _delete(tables: dict[str, tuple], path: str) -> None:
    system, where, _ = tables.pop(path)
    system.delete(where, True)
    system.cancelDeleteOnExit(where)


def hold(spark: SparkSession, path: str, table: DataFrame | None = None) -> None:
    """Has a folder that is written now removed with the session, or once nothing reads the table that it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    read = None
    if table is not None:
        read = jvm.java.lang.ref.WeakReference(table._jdf.queryExecution().analyzed().collectLeaves().head().relation().location())
    _held(spark)[path] = system, where, read
    system.deleteOnExit(where)


def swept(spark: SparkSession) -> None:
    """Removes the tables of earlier results that are gone: no plan in the JVM holds their files any more.

    A frame that is made of a result holds its tables, as a cached or running one does; an RDD made of it does not.
    """
    tables = _held(spark)
    for path in [p for p, (_, _, read) in tables.items() if read is not None and read.get() is None]:
        _delete(tables, path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a held folder now."""
    if path in (tables := _held(spark)):
        _delete(tables, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: whoever reads it needs nothing that came before.

    The shuffle files of the job that wrote it are removed when it ends, so that a query of several such steps holds the
    files of one step at a time. The table stays until drop() or settled() removes it, or nothing reads it any more.
    """
    spark = df.sparkSession
    swept(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    except BaseException:
        hold(spark, path)
        raise
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    hold(spark, path, out)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing reads them any more; other frames are left alone."""
    for table in tables:
        if hasattr(table, "cut_path"):
            remove(table.sparkSession, table.cut_path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns as a table; the tables that were cut on the way to it go."""
    before = set(_held(spark))
    out = cut(make(), label)
    for path in set(_held(spark)) - before - {out.cut_path}:
        remove(spark, path)
    return out
