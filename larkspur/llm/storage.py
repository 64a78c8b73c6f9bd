"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of this application under ``spark.checkpoint.dir``.

    A folder of this machine is made up only where the setting is absent and the master is local.
    """
    sc = spark.sparkContext
    if sc.applicationId in _roots:
        return _roots[sc.applicationId]
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-")
    root = _roots[sc.applicationId] = f"{base.rstrip('/')}/larkspur-{sc.applicationId}"
    atexit.register(_clean, spark, root)
    return root


def _clean(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, root)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that its scheme names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARALLEL_FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, name: str, narrow: bool = False) -> str:
    """Writes ``df`` as Parquet to a new folder and returns its path.

    The written table takes the place of the shuffles behind it, so Spark deletes their files as the write ends. A
    ``narrow`` table, of ids only, gets partitions of the advised size, be they one, instead of one for each core.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, {CLEANUP: "true"} | ({PARALLEL_FIRST: "false"} if narrow else {})):
        df.write.option("compression", "zstd").parquet(path)
    return path


def kept(df: DataFrame, name: str, narrow: bool = False) -> tuple[DataFrame, str]:
    """``stage`` and the path of what it wrote, for ``remove`` once nothing reads it."""
    path = write(df, name, narrow)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Cuts the lineage: writes ``df`` and reads it back, so that a lost executor costs no recomputation before it."""
    spark, schema = df.sparkSession, df.schema
    return spark.read.schema(schema).parquet(write(df, name, narrow))
