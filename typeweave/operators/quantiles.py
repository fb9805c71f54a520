"""Exact quantiles of a key of any size, without a buffer of its values.

Values are counted, the counts are cut into sampled ranges of the value, and running sums over
ranges and within them tell which value holds a rank; only the two values beside each
rank are kept. A hot key's values are dealt over all ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.offsets import exclusive_sums, placed


def exact_quantiles(df: DataFrame, by: list[str], value: str, parts: list[float]) -> DataFrame:
    """(by..., quantiles, n): the values at each of ``parts`` of the way from least to greatest, between neighbours in proportion.

    Nulls are left out, also in ``by``; a key without values has no row.
    """
    keys = by or ["_all"]
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).dropna()
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = exclusive_sums(placed(counts, keys, ["_v"], "_place"), keys, "_place", "_n", "_before")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    ranks = F.array(*(F.struct(F.lit(k).alias("_k"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for k, p in enumerate(parts)))
    held = lambda r: (F.floor(r["at"]) < F.col("_before") + F.col("_n")) & (F.ceil(r["at"]) >= F.col("_before"))
    near = upto.join(totals.withColumn("_ranks", ranks), keys).select(*keys, "n", "_v", "_before", "_n", F.explode(F.filter("_ranks", held)).alias("_r"))
    low = F.min("_v")  # of the one or two values beside the rank
    each = near.groupBy(*keys, "n", F.col("_r._k").alias("_k")).agg((low + (F.max("_v") - low) * (F.max("_r.at") - F.floor(F.max("_r.at")))).alias("_q"))
    return each.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_q"))), lambda x: x["_q"]).alias("quantiles")).select(*by, "quantiles", "n")
