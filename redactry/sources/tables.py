"""Parquet table access with the column set a plan needs and nothing else."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from redactry.sources.shipping import ship


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; with ``columns`` only these are kept.

    Only named columns survive, so extra columns of the input can never clash
    with names an operator adds.
    """
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, where a scan has fewer partitions than there are cores.

    Files are split by bytes, but text costs far more time than reading it, so a
    small table would keep one core busy. Large tables have partitions enough and
    are not touched, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # asking for its partitions would run it
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    It is read from the session; only in local mode, where nobody set one, a
    temporary folder takes its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="redactry-"))
    return folder


_local: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read them from there.

    A lost executor costs no recomputation, and unlike ``DataFrame.checkpoint`` the
    plan runs only once. The table is removed when the driver's Python ends, or by
    :func:`discard` before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`checkpointed` that no later plan reads."""
    for df in tables:
        _remove(df.sparkSession, df._table)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone and its shared folder with it
        pass
