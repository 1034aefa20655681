"""Session settings, the shared scratch folder and table materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest number of rows of one group that a single task may sort or hold.
# Above it the operators in `operators.grouping` switch to range-split plans.
HOT_GROUP_ROWS = 2_000_000

_local_dirs: dict[str, str] = {}


def hot_group_rows(spark: SparkSession) -> int:
    """Group size above which the range-split plans are used."""
    return int(spark.conf.get("spark.formbook.hotGroupRows", str(HOT_GROUP_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its
    own; on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/formbook/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage and keeps what a checkpoint loses: column pruning, filter
    pushdown and a known size for join planning.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether `path` exists on its own file system (local, HDFS, object store)."""
    fs, target = _file_system(spark, path)
    return bool(fs.exists(target))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def delete_tree(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
