"""Tables between jobs: written below the folder that driver and executors share, gone when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset in local mode; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no other table has, in a folder of this application that is deleted when it ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/lodestrata-tables/{app}"
    if app not in _MARKED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(app)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: later jobs start from files, whatever executors are lost meanwhile."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
