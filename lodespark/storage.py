"""Where intermediate tables go: the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (local tests) a
temporary folder of this machine is taken; any other master raises. Tables written here are removed when the driver exits.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodespark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; removed at the driver's exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table to the shared folder and reads it back: lineage ends there.

    The table survives the loss of executors, unlike a cache or a local checkpoint.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder; no error if it is gone already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path`` whose tables were written to the end; none where there is no such path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
    return [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int, order: str | None = None) -> DataFrame:
    """Writes ``df`` to ``path`` in buckets by ``keys`` and reads it back: joins of two such tables on ``keys`` move nothing.

    Within a bucket rows are sorted by ``order``, so that a filter on it skips the pages of other values.

    Bucketed files need a name in the session's catalog while they are written; it is dropped again.
    """
    name = f"lodespark_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    (writer.sortBy(order) if order else writer).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"drop table {name}")
    return open_bucketed(df.sparkSession, path, df.schema, keys, buckets)


def open_bucketed(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> DataFrame:
    """The table of ``write_bucketed``, in any later session."""
    name = f"lodespark_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(f'`{k}`' for k in keys)}) into {buckets} buckets location '{path}'")
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # an external table: its files stay
    return out


def release() -> None:
    """Removes all tables written so far; results that still read them must be done. For sessions that live long."""
    while _written:
        spark, path = _written.pop()
        drop_path(spark, path)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session is gone; nothing can be removed any more
        return
