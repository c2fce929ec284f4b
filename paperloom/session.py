"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session gets a temporary folder (removed at exit) and any other
    session a folder below the warehouse, which its executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_paperloom"
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return _LOCAL["dir"]


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and lost executors cost nothing.

    ``folders``: columns by whose values the table is laid out in folders, so that reading some values opens no others.
    """
    path = f"{shared_folder(df.sparkSession)}/paperloom/{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a shuffle of the session has, for work that is heavy by the row.

    Files are split by their bytes, and only between groups of rows: a million small rows may be one task's.
    """
    spark = df.sparkSession
    # A number that is asked for isn't merged again by the rows' few bytes.
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
