"""Shared storage for cutting lineage.

The folder named by ``spark.checkpoint.dir`` is reachable from every executor. Intermediate
tables are written there as Parquet, so a lost executor never loses them and nothing upstream
has to be computed twice. Where the setting is absent (tests, local runs) a folder of this
process is used; on a cluster the setting is required.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None
#: this process's own folder in the shared one
_OWN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, else a local one on local masters."""
    global _local_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


def own_dir(spark: SparkSession) -> str:
    """This process's folder for intermediate tables; it goes when the process ends, or by ``release``."""
    return f"{shared_dir(spark)}/quillstone/{_OWN}"


def release(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this process. Results that are not yet computed can not be afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context else None
    if spark is not None and (_local_dir or spark.conf.get("spark.checkpoint.dir", None)):
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the session may be on its way down; its folder stays then
            pass


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back, with a fresh lineage; the rows of each
    value of the column ``by`` in files of their own."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files go of results that nothing refers to any more; Spark deletes them when the driver
    collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
