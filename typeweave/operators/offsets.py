"""Exact ranks and running sums without a window over all rows.

A window that numbers every row of a table, or of one hot group, runs in one
task. Here rows are cut into ranges of their sort key, counts of the ranges are
summed up in two levels, and each row's rank is its range's offset plus its
place within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.sources.tables import handed_over, shuffle_partitions


def exclusive_sums(counts: DataFrame, group: list[str], order: str, value: str | dict[str, str], out: str | None = None, fan: int = 256, kind: str = "bigint") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one; or several, {out: value}.

    ``order`` is a non-negative integer, unique within a group, and no column
    of ``group`` or ``order`` is null. No window sees more than ``fan`` rows of
    adjoining ``order``, or one row for each ``fan`` of them. Sums of ``kind`` start from 0.
    """
    outs = value if isinstance(value, dict) else {out: value}
    none = F.lit(0).cast(kind)
    blocked = counts.withColumn("_block", F.floor(F.col(order) / fan).cast("bigint"))
    in_block = blocked.groupBy(*group, "_block").agg(*(F.sum(v).alias(f"_in_{o}") for o, v in outs.items()))
    before_block = in_block.select(*group, "_block", *(F.coalesce(F.sum(f"_in_{o}").over(_w(group, "_block")), none).alias(f"_before_block_{o}") for o in outs))
    inside = blocked.withColumns({f"_before_row_{o}": F.coalesce(F.sum(v).over(_w([*group, "_block"], order)), none) for o, v in outs.items()})
    sums = inside.join(before_block, [*group, "_block"]).withColumns({o: (F.col(f"_before_block_{o}") + F.col(f"_before_row_{o}")).cast(kind) for o in outs})
    return sums.drop("_block", *(f"_before_{part}_{o}" for part in ("block", "row") for o in outs))


def _w(group: list[str], order: str):
    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based place of the row in its group.

    Rows of a group are ordered by ``bucket``, a non-negative integer, and
    within a bucket by ``order``. Callers choose buckets of a bounded number of
    rows; no task sees more than a few whole buckets.
    """
    keyed = df.withColumn("_bucket", bucket.cast("bigint"))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One key of group and bucket: rows that are already dealt out by group alone would else stay in one task.
    cell = F.struct(*group, "_bucket").alias("_cell")
    offsets = exclusive_sums(counts, group, "_bucket", "_n", "_offset").select(cell, "_offset")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1
    return (
        keyed.withColumn("_cell", cell)
        .withColumn("_in_cell", place)
        .join(offsets, "_cell")
        .withColumn(out, (F.col("_offset") + F.col("_in_cell")).cast("bigint"))
        .drop("_cell", "_bucket", "_in_cell", "_offset")
    )


def placed(df: DataFrame, group: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based place of the row in its group, for an order of any types.

    Spark samples the order and deals the rows out by ranges of group and order, so
    that a hot group fills many ranges; the ranges are written, as a sample drawn
    again could differ, and are the buckets of ``ranked``. Columns of ``group``
    have no nulls, and the order is total within a group.
    """
    parts = shuffle_partitions(df.sparkSession)
    ranges = handed_over(df.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    if not group:
        return ranked(ranges.withColumn("_all", F.lit(0)), ["_all"], F.col("_range"), order, out).drop("_all", "_range")
    return ranked(ranges, group, F.col("_range"), order, out).drop("_range")
