"""Intermediate tables in the folder that all executors share.

The folder is the one in ``spark.checkpoint.dir``; only where that is unset and all runs on one
machine (tests, a laptop) a folder of our own is made. On a cluster the setting is demanded. What lies there survives the loss of executors, so the plans that follow
read it instead of recomputing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results, as a URI or path."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "settled", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it (lineage ends there).

    Written as a table rather than by ``checkpoint()``: Parquet keeps column pruning and pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(table: DataFrame) -> DataFrame:
    """A table's rows over all cores, if its files make fewer input splits than there are cores.

    For small tables in front of Python work; a table with enough splits is left as it is, unshuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
