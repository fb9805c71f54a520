"""Proportional stratified interleaving into shards.

Within each source, rows are ranked in an order that a seed fixes; a row's
fractional rank is (2 * rank + 1) / (2 * rows of its source). Sorting all rows
by fractional rank interleaves the sources in proportion, and cutting the sorted
rows into runs of equal length (one row more or less) gives shards that each
match the mixture to about one row of each source. The law is ``rows``.

Ranks are exact but never numbered in one window: rows are dealt out by sampled ranges of
their order, so that a hot source, or rows that are alike in all, fill many ranges (see
operators.offsets). Only ids, sizes and checksums are shuffled, never texts.

Defined results: a null source is a source of its own; a null text has no bytes;
null and repeated ids, and repeated rows, are placed like others (rows that are
alike in id, source and text can't be told apart, so any order among them is the
same result); very long texts are only measured; other columns are left out, whatever their names; an empty table gives no rows; with
more shards than rows, some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.offsets import placed
from typeweave.sources.tables import handed_over


def interleaved(docs: DataFrame, shards: int, seed: int = 42, row_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per input row: row_id, source, size, text_crc32, position, shard, slot.

    position is the row's place among all rows, shard the run it falls in and
    slot its place there, both gapless from 0.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(row_id).alias("row_id"),
        F.col(source).alias("source"),
        (F.octet_length(body) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    # _row tells rows apart that are alike in all; once written it stays.
    slim = slim.withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "_shuffle": F.xxhash64(F.lit(seed), "row_id", "source", "text_crc32", "size"),
        "_row": F.monotonically_increasing_id(),
    })
    slim = handed_over(slim, "shard-rows")
    totals = handed_over(slim.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows")), "shard-sources")
    total = totals.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]  # one number
    if total == 0:
        return slim.select("row_id", "source", "size", "text_crc32", *(F.lit(0).cast(t).alias(c) for c, t in (("position", "bigint"), ("shard", "int"), ("slot", "bigint"))))

    in_source = placed(slim, ["_source"], ["_shuffle", "row_id", "text_crc32", "size", "_row"], "_rank")
    fraction = (2 * F.col("_rank") + 1) / (2 * F.col("_rows"))
    overall = placed(in_source.join(totals, "_source").withColumn("_fraction", fraction), [], ["_fraction", "_source", "_rank"], "position")
    return (
        overall.withColumn("shard", F.expr(f"cast(position * {shards}L div {total}L as int)"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}L) div {shards}L"))
        .select("row_id", "source", "size", "text_crc32", "position", "shard", "slot")
    )
