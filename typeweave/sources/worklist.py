"""Appends that survive reruns, and what of a work list is still to be done.

A table of this kind is a folder with parts and a manifest. A batch writes its parts under a name of
its own and then one manifest file, which is created whole or not at all and names them; readers see
the parts of the manifest alone. So a batch that was killed leaves nothing that is read, and
one that runs again adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, folder: str) -> dict[str, str]:
    """The folder of each batch's parts; a batch is one short line, so there are as many as there were runs."""
    path, system = _files(spark, folder)
    if not system.exists(path):
        return {}
    lines = spark.read.text(str(path), pathGlobFilter="*.json").collect()
    return {entry["batch"]: entry["parts"] for entry in (json.loads(r["value"]) for r in lines)}


def append_once(df: DataFrame, folder: str, batch: str) -> bool:
    """Adds the rows under the name of the batch unless it was added before; whether they were added."""
    spark = df.sparkSession
    if batch in _committed(spark, folder):
        return False
    parts = f"parts/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{parts}")
    path, system = _files(spark, folder)
    fs = spark._jvm.org.apache.hadoop.fs
    own = fs.Path(path, f".{uuid.uuid4().hex}")
    out = system.create(own)
    try:
        out.write(bytearray(json.dumps({"batch": batch, "parts": parts}).encode() + b"\n"))
    finally:
        out.close()
    name = "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in batch)
    target = fs.Path(path, f"{name}.json")
    if system.exists(target) or not system.rename(own, target):  # another run was first
        system.delete(own, False)
        system.delete(fs.Path(f"{folder}/{parts}"), True)
        return False
    return True


def appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of committed batches."""
    found = [f"{folder}/{parts}" for parts in _committed(spark, folder).values()]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def pending(work: DataFrame, folder: str, key: str, schema: T.StructType) -> DataFrame:
    """The items of the work list that no committed batch has."""
    return work.join(appended(work.sparkSession, folder, schema).select(key), key, "left_anti")


def followed(spark: SparkSession, source: str, schema: T.StructType, folder: str, name: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Applies ``step`` to the files that came to ``source`` since the last call, each batch once, and appends its rows."""
    stream = spark.readStream.schema(schema).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        append_once(step(df), folder, f"{name}-{number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/stream-{name}").trigger(availableNow=True).start().awaitTermination()
