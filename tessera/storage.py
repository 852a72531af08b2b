"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the directory that the context was given. Where there is neither, a
    folder of this machine on a local master (tests); on a cluster that is an error, as executors don't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else getattr(spark.sparkContext, "_tessera_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.sparkContext._tessera_dir = tempfile.mkdtemp(prefix="tessera-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def open_store(uri: str):
    """The pyarrow file system of a folder and its path there, for worker functions that read or write files themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def materialise(df: DataFrame, name: str, compact: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage is cut and a lost executor costs no
    recomputation. ``compact``, for what a cheap last step makes of few bytes: no more tasks and files than cores.
    ``codec``: how Parquet packs it, if not as the session does."""
    if compact:
        df = df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def bounded_broadcast(table: DataFrame, most_rows: int = 300_000) -> DataFrame:
    """A hint to broadcast a materialised table of narrow rows, only if it has at most ``most_rows``; else it is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= most_rows else table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._tessera_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
