"""Scans of the input tables and hand-over points between stages of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and
    the master is local, as in tests, a temporary folder of this machine is taken
    and kept in the session for later calls; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("typeweave.scratch.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="typeweave-")
        spark.conf.set("typeweave.scratch.dir", folder)
    return folder.rstrip("/")


def handed_over(df: DataFrame, what: str, partition_by: str | None = None, row_group: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    It cuts the lineage in a way that outlives executors, and the files give
    Catalyst the true size, so that a later join can weigh a broadcast.

    ``row_group`` is for large rows: Parquet checks sizes only after 100 rows, and its
    reader takes up to 4,096 rows of a row group at once. With it, sizes are checked
    after each row, and a row group ends at about so many bytes (a row beyond, at most).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if row_group:
        writer = writer.options(**{"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes the files of a table that ``handed_over`` gave and nothing reads any more; other files stay."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(shared_folder(spark)) or folder.removeprefix("file://").startswith(shared_folder(spark).removeprefix("file://")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
