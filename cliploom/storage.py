"""Tables and folders that a query keeps in the folder that all executors and the driver share.

Everything written here is deleted when the Python process ends, or earlier: discard() for what is used up, sweep() once
all results are written. A DataFrame read from such a table must be written before its table goes.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written and not yet deleted, with the session's JVM.
_kept: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset and Spark runs in one machine, an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = "file://" + tempfile.mkdtemp(prefix="cliploom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _kept[folder] = spark.sparkContext
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark.sparkContext
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table and read back: it is computed once, and lost executors cost no more than one stage."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark.sparkContext, path)


def _delete(context: object, path: str) -> None:
    jvm = context._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()  # the session may have ended
    where.getFileSystem(conf).delete(where, True)
    _kept.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote; others are left alone."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            delete(df.sparkSession, path)


def folders() -> list[str]:
    """Folders not yet deleted, oldest first."""
    return list(_kept)


def sweep(since: int = 0) -> None:
    """Delete all folders but the `since` oldest."""
    for path in list(_kept)[since:]:
        _delete(_kept[path], path)


@atexit.register
def _at_exit() -> None:
    for path, context in list(_kept.items()):
        try:
            _delete(context, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; its temporary folders are the system's then
            return
