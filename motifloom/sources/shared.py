"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder, as a whole URI.

    It lies below ``spark.checkpoint.dir``, or else below the folder given to setCheckpointDir(); a path
    without a scheme belongs to the default file system, as everywhere in Spark.  Where neither
    is set, a folder of this machine serves in local mode, and a cluster gets an error.  The folder is
    removed when the driver's process ends.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    if ":" not in base.split("/")[0]:
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    own = f"{base.rstrip('/')}/motifloom/{context.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, own)
    return own


def _remove(folder: str) -> None:
    if folder.startswith("file:"):
        shutil.rmtree("/" + folder[len("file:"):].lstrip("/"), ignore_errors=True)
        return
    from pyarrow import ArrowException, fs

    try:
        system, path = fs.FileSystem.from_uri(folder)
        system.delete_dir(path)
    except (OSError, ArrowException):  # no client for this file system, or the folder is gone
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """An unused path in this application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back: it is computed once, its lineage ends, and it outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
