"""Session helpers: tables, shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a frame that a join may send through the driver.
MOST_SENT = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session in
    which it is unset gets a folder of its own, removed at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="alertloom-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when its driver ends in order."""
    folder = f"{shared_dir(spark)}/alertloom/{spark.sparkContext.applicationId}"
    if folder not in _own_folder.known:
        _own_folder.known.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_own_folder.known = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001, S110 - the session has ended before: its folder is left to the cluster
        pass


def materialise(df: DataFrame, *by: str) -> DataFrame:
    """Write a frame to the shared folder, parted by columns if any are given, and read it back.

    Cuts the lineage, survives the loss of executors, and keeps an expensive
    frame that is used more than once from being computed again.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has so many rows at most: sent to all executors if they are few, shuffled by its keys if not.

    Left to itself Spark judges by the size of compressed files, and takes rows
    that functions make for as many as went in: what it then sends through the
    driver may be many times larger than its threshold.
    """
    return F.broadcast(df) if rows <= MOST_SENT else df.hint("merge")


def written_at(df: DataFrame) -> str:
    """The full address of a materialised frame's files, for readers outside the session."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + at[5:] if at.startswith("file:/") and not at.startswith("file:///") else at


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        written = getattr(df, "_written", None)
        if written:
            spark = df.sparkSession
            _remove(spark, written)
            del df._written
