"""Tables that operators write for themselves: fixed rows, short lineage, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose executors are the driver, may do without: it gets a new folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sigweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, compression: str | None = None, **options: str) -> DataFrame:
    """df as a table written once to the shared folder, with options of the Parquet writer: its rows are fixed from here on and its lineage ends.

    The files live until release() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sigweave/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression=compression)
    if not _written:
        atexit.register(lambda: [_remove(s, p) for p, s in _written.items()])
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes the files of tables that materialise() gave and that no plan reads any more."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before
        pass
