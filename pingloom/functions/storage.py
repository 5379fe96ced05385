"""Tables in the folder that the cluster shares: lineage is cut there, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster fails:
    its executors do not share the driver's folders."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    if not conf:
        conf = "file://" + (made := tempfile.mkdtemp(prefix="pingloom-"))
        atexit.register(shutil.rmtree, made, True)
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for what a query writes and reads back."""
    path = f"{shared_dir(spark)}/pingloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def dropped(df: DataFrame) -> None:
    """Delete a table that ``stored`` gave, once all that is computed from it has been collected or stored."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        name = next((x for x in _written if path.rstrip("/").endswith(x.rsplit("/", 1)[1])), None)
        if name:
            _delete(df.sparkSession, name)
            _written.remove(name)


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has stored, once no result reads them any more; gives their number."""
    done = 0
    while _written:
        done += _delete(spark, _written.pop())
    return done
