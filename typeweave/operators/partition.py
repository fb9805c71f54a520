"""Agreement of categorical partitions, from exact integer pair counts.

A partition is a column of labels; rows that lack any label of a statistic are
left out of it, and the number of rows used is returned beside each value. All
statistics are built on the contingency table, which is aggregated once, and pair
counts stay exact (DECIMAL) until the last division. Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.operators.resample import intervals
from typeweave.sources.tables import handed_over, shuffle_partitions

Z = 1.96
MOST_SENT = 100_000  # rows of a table of counts that may be broadcast
PAIRS_TOGETHER = 1 << 14  # pairs of class sizes whose terms are held at once
DIGITS = 8  # sums of doubles differ in their last bits from plan to plan


def pairs_in(n: str | Column) -> Column:
    """Unordered pairs among n rows, as DECIMAL(38, 0): the even factor is halved first, and products of 64 bits fit."""
    n = F.col(n) if isinstance(n, str) else n
    half = lambda k: F.shiftright(k, 1).cast("decimal(19,0)")
    return F.when(n % 2 == 0, half(n) * (n - 1).cast("decimal(19,0)")).otherwise(half(n - 1) * n.cast("decimal(19,0)")).cast("decimal(38,0)")


def spectrum(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., kind, size, times): how many cells (kind 0), classes of a (1) and classes of b (2) have each size.

    One pass over the contingency table by grouping sets. Every statistic of this module is a
    function of these sizes, of which there are at most about the root of twice the rows.
    """
    by = by or []
    kind = (F.when(F.grouping("b") == 1, 1).when(F.grouping("a") == 1, 2).otherwise(0)).alias("kind")
    sizes = cells.groupingSets([[*by, "a", "b"], [*by, "a"], [*by, "b"]], *by, "a", "b").agg(F.sum("n").alias("size"), kind)
    return sizes.groupBy(*by, "kind", "size").agg(F.count(F.lit(1)).alias("times"))


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each pair of classes over the rows that have both."""
    by = by or []
    return (
        df.select(*by, F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
        .groupBy(*by, "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_counts(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``): rows n, and the pairs alike in both, in a, in b as DECIMAL(38, 0)."""
    by = by or []
    none = F.lit(0).cast("decimal(38,0)")
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("times") * pairs_in("size"))), none).cast("decimal(38,0)")
    return spectrum(cells, by).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("times") * F.col("size"))), F.lit(0)).alias("n"),
        part(0).alias("both"), part(1).alias("in_a"), part(2).alias("in_b"),
    )


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _all_pairs() -> Column:
    return pairs_in(F.col("n")).cast("double")


def _wallace() -> Column:
    return _ratio(_d("both"), _d("in_a"))


def _adjusted_wallace() -> Column:
    by_chance = _ratio(_d("in_b"), _all_pairs())
    return F.when(by_chance < 1, (_wallace() - by_chance) / (1 - by_chance))


def _adjusted_rand() -> Column:
    """Two partitions that are both trivial in the same way agree fully."""
    expected = _ratio(_d("in_a") * _d("in_b"), _all_pairs())
    mean = (_d("in_a") + _d("in_b")) / 2
    return F.when(mean == expected, 1.0).otherwise((_d("both") - expected) / (mean - expected))


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Wallace a to b, adjusted Wallace and adjusted Rand index of two partitions."""
    return agreement_of(contingency(df, a, b, by), by)


def agreement_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``agreement`` of a contingency table."""
    return pair_counts(cells, by).select(
        *(by or []), F.round(_wallace(), DIGITS).alias("wallace"), F.round(_adjusted_wallace(), DIGITS).alias("adj_wallace"),
        F.round(_adjusted_rand(), DIGITS).alias("ari"), "n",
    )


def simpson(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Simpson's diversity with its interval, the number of types and of rows."""
    by = by or []
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
    c = _d("c")
    sums = counts.groupBy(*by).agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("types"), F.sum(pairs_in("c")).alias("alike"),
        F.sum(c * c).alias("s2"), F.sum(c * c * c).alias("s3"),
    )
    n = _d("n")
    d = 1 - _ratio(_d("alike"), pairs_in(F.col("n")).cast("double"))
    se = F.sqrt(F.greatest((4 / n) * (F.col("s3") / (n * n * n) - F.pow(F.col("s2") / (n * n), 2)), F.lit(0.0)))
    return sums.select(
        *by, F.round(d, DIGITS).alias("simpson"),
        F.when(d.isNotNull(), F.round(F.greatest(F.lit(0.0), d - Z * se), DIGITS)).alias("lo"),
        F.when(d.isNotNull(), F.round(F.least(F.lit(1.0), d + Z * se), DIGITS)).alias("hi"), "types", "n",
    )


def _log_factorial(n: Column) -> Column:
    """Exact below 16, else Stirling's series, which is then right to 13 digits."""
    small = F.array(*(F.lit(v) for v in _SMALL))
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(x * 6.283185307179586) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < len(_SMALL), F.get(small, n.cast("int"))).otherwise(series)


def _small_logs() -> list[float]:
    from math import lgamma

    return [lgamma(k + 1) for k in range(16)]


_SMALL = _small_logs()


def _every_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of ``a`` with each of ``b``: b is sent if it is small, else both are dealt out in blocks that meet by key."""
    b = handed_over(b, "margins")
    rows = b.count()
    if rows <= MOST_SENT:
        return a.crossJoin(F.broadcast(b))
    blocks = -(-rows // MOST_SENT)
    dealt = b.withColumn("_block", F.pmod(F.xxhash64(*b.columns), F.lit(blocks).cast("bigint")))
    every = a.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return every.join(dealt, "_block").drop("_block")


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ami, mi, expected, n) with the mean of the entropies as the bound.

    The expected value sums over pairs of distinct margins, weighted by how many
    classes have them, and over the cell counts within 14 deviations of the
    hypergeometric mean, beyond which nothing adds to a double.
    """
    return mutual_information_of(handed_over(contingency(df, a, b), "cells"))


def mutual_information_of(cells: DataFrame) -> DataFrame:
    """``adjusted_mutual_information`` of a contingency table, which is read several times."""
    of_a = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    of_b = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"))  # one row
    big = F.broadcast(total)
    n, N, ra, cb = _d("n"), _d("total"), _d("ra"), _d("cb")
    mi = cells.join(of_a, "a").join(of_b, "b").crossJoin(big).agg(F.sum(n / N * F.ln(n * N / (ra * cb))).alias("mi"), F.max("total").alias("total"))
    entropy = lambda t, c: t.crossJoin(big).agg((-F.sum(c / N * F.ln(c / N))).alias("h"))
    # Distinct margins with their multiplicities: far fewer than classes.
    margins = _every_pair(of_a.groupBy("ra").agg(F.count(F.lit(1)).alias("ma")), of_b.groupBy("cb").agg(F.count(F.lit(1)).alias("mb"))).crossJoin(big)
    mean = ra * cb / N
    wide = 14 * F.sqrt(mean * (1 - ra / N) * (1 - cb / N) * F.when(N > 1, N / (N - 1)).otherwise(1.0)) + 40
    low = F.greatest(F.lit(1), F.col("ra") + F.col("cb") - F.col("total"), F.floor(mean - wide).cast("bigint"))
    high = F.least("ra", "cb", F.ceil(mean + wide).cast("bigint"))
    k = F.col("k")
    logs = lambda *cols: sum((_log_factorial(c) for c in cols[1:]), _log_factorial(cols[0]))
    chance = F.exp(
        logs(F.col("ra"), F.col("cb"), F.col("total") - F.col("ra"), F.col("total") - F.col("cb"))
        - logs(F.col("total"), k, F.col("ra") - k, F.col("cb") - k, F.col("total") - F.col("ra") - F.col("cb") + k)
    )
    term = k / N * F.ln(N * k / (ra * cb)) * chance
    expected = (
        margins.where(low <= high).select("ma", "mb", "ra", "cb", "total", F.explode(F.sequence(low, high)).alias("k"))
        .agg(F.coalesce(F.sum(F.col("ma") * F.col("mb") * term), F.lit(0.0)).alias("emi"))
    )
    row = mi.crossJoin(entropy(of_a, ra).withColumnRenamed("h", "ha")).crossJoin(entropy(of_b, cb).withColumnRenamed("h", "hb")).crossJoin(expected)
    bound = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    value = F.when((F.col("ha") == 0) & (F.col("hb") == 0), 1.0).otherwise(_ratio(F.col("mi") - F.col("emi"), bound))
    return row.select(F.round(value, 6).alias("ami"), F.round("mi", 6).alias("mi"), F.round("emi", 6).alias("expected"), F.col("total").alias("n"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The interval of k of n, within 0 and 1; null where n is 0."""
    n, p = n.cast("double"), k.cast("double") / F.when(n != 0, n.cast("double"))
    den = 1 + Z * Z / n
    mid = (p + Z * Z / (2 * n)) / den
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / den
    some = lambda x: F.when(p.isNotNull(), F.round(x, DIGITS))
    return some(F.greatest(F.lit(0.0), mid - half)), some(F.least(F.lit(1.0), mid + half))


def confusion(df: DataFrame, predicted: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """Counts, sensitivity and specificity with intervals, and predictive value of a binary predictor.

    Rows where either is null are left out.
    """
    by = by or []
    rows = df.select(*by, predicted.alias("p"), truth.alias("t")).where("p IS NOT NULL AND t IS NOT NULL")
    counts = rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in {"tp": F.expr("p AND t"), "fp": F.expr("p AND NOT t"), "fn": F.expr("NOT p AND t"), "tn": F.expr("NOT p AND NOT t")}.items()))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    (sl, sh), (pl, ph) = wilson(tp, tp + fn), wilson(tn, tn + fp)
    share = lambda x, n: F.round(_ratio(x.cast("double"), n.cast("double")), DIGITS)
    return counts.select(
        *by, "tp", "fp", "fn", "tn", share(tp, tp + fn).alias("sens"), sl.alias("sens_lo"), sh.alias("sens_hi"),
        share(tn, tn + fp).alias("spec"), pl.alias("spec_lo"), ph.alias("spec_hi"), share(tp, tp + fp).alias("ppv"),
    )


def _expected_information(ones: np.ndarray, times: np.ndarray, others: np.ndarray, others_times: np.ndarray, total: int) -> float:
    """Expected mutual information of classes of sizes ``ones`` and ``others``, over the cell counts within 9 deviations of the mean.

    Pairs of sizes are taken in runs of about ``PAIRS_TOGETHER``. Where neither bound of the counts is that near, the sum
    is taken in steps of half a deviation, times the step: for a bell the two sums differ by less than e^-70 of it, so a double
    holds the same value, and a pair of sizes costs some 40 terms however many rows there are. Where a bound is near, the deviation is below 11.
    """
    logs, found, run = _log_factorials(total), 0.0, max(PAIRS_TOGETHER // len(others), 1)
    for start in range(0, len(ones), run):
        a, b = np.repeat(ones[start : start + run], len(others)), np.tile(others, len(ones[start : start + run]))
        weight = np.repeat(times[start : start + run], len(others)) * np.tile(others_times, len(ones[start : start + run]))
        mean = a * (b / total)
        deviation = np.sqrt(mean * (1 - a / total) * (1 - b / total) * (total / max(total - 1, 1)))
        wide = 9 * deviation + 12
        least, most = np.maximum(1, a + b - total), np.minimum(a, b)
        free = (mean - wide > least) & (mean + wide < most)
        step = np.where(free, np.maximum(deviation // 2, 1), 1).astype(np.int64)
        weight = weight * step
        low = np.maximum(least, np.floor(mean - wide)).astype(np.int64)
        high = np.minimum(most, np.ceil(mean + wide)).astype(np.int64)
        each = np.maximum((high - low) // step + 1, 0)
        known = logs(a) + logs(b) + logs(total - a) + logs(total - b) - logs(np.int64(total))
        i = np.repeat(np.arange(len(a)), each)
        k = (np.arange(len(i)) - (np.cumsum(each) - each)[i]) * step[i] + low[i]
        chance = np.exp(known[i] - logs(k) - logs(a[i] - k) - logs(b[i] - k) - logs((total - a - b)[i] + k))
        found += float(np.sum(weight[i] * (k / total) * np.log(total / a[i] * (k / b[i])) * chance))
    return found


@lru_cache(16)
def _log_factorials(total: int) -> Callable[[np.ndarray], np.ndarray]:
    """Logarithms of factorials up to ``total``: a table where it is short, else as ``_log_factorial``."""
    if total <= 1 << 20:
        table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, total + 1)))))
        return lambda n: table[n]

    def series(n: np.ndarray) -> np.ndarray:
        x = np.maximum(n.astype(float), 16)
        one = 1 / x
        square = one * one
        large = (x + 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + one * (1 / 12 - square * (1 / 360 - square / 1260))
        return np.where(n < 16, np.array(_SMALL)[np.minimum(n, 15)], large)

    return series


def statistics_of(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., ari, adj_wallace, ami, simpson_one, simpson_two) of each group of a contingency table, for ``resample.intervals``.

    The mutual information of a group is worked out from its distinct class sizes.
    """
    by = by or []
    size, times = _d("size"), _d("times")
    kind = lambda k, value: F.coalesce(F.sum(F.when(F.col("kind") == k, value)), F.lit(0.0))
    listed = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("size", "times")))
    # Sums of doubles are exact below 2**53 pairs and right to 15 digits beyond.
    sums = spectrum(cells, by).groupBy(*by).agg(
        kind(0, size * times).alias("n"), *(kind(k, size * (size - 1) / 2 * times).alias(name) for k, name in enumerate(("both", "in_a", "in_b"))),
        *(kind(k, size * F.ln(size) * times).alias(f"_h{k}") for k in range(3)), listed(1).alias("_ones"), listed(2).alias("_others"),
    )
    if by:  # groups are small rows of long work: a number of partitions keeps them from being put together by their bytes
        sums = sums.repartition(shuffle_partitions(cells.sparkSession), F.xxhash64(*by))

    @F.pandas_udf("double")
    def expected(ones: pd.Series, others: pd.Series, total: pd.Series) -> pd.Series:
        sides = lambda held: (np.array([x["size"] for x in held], np.int64), np.array([x["times"] for x in held], np.int64))
        return pd.Series([_expected_information(*sides(a), *sides(b), int(n)) for a, b, n in zip(ones, others, total)], dtype=float)

    n, pairs = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    entropy = lambda k: F.ln(n) - F.col(f"_h{k}") / n
    mi = F.ln(n) + (F.col("_h0") - F.col("_h1") - F.col("_h2")) / n
    bound = (entropy(1) + entropy(2)) / 2
    chance = F.col("in_a") * F.col("in_b") / F.when(pairs > 0, pairs)
    by_chance = F.col("in_b") / F.when(pairs > 0, pairs)
    mean = (F.col("in_a") + F.col("in_b")) / 2
    full = sums.withColumn("_emi", expected("_ones", "_others", "n"))
    one_class = (F.size("_ones") == 1) & (F.size("_others") == 1) & (F.get("_ones", 0)["times"] == 1) & (F.get("_others", 0)["times"] == 1)
    return full.select(
        *by, F.when(mean == chance, 1.0).otherwise((F.col("both") - chance) / (mean - chance)).alias("ari"),
        F.when((by_chance < 1) & (F.col("in_a") > 0), (F.col("both") / F.col("in_a") - by_chance) / (1 - by_chance)).alias("adj_wallace"),
        F.when(one_class, 1.0).otherwise(_ratio(mi - F.col("_emi"), bound - F.col("_emi"))).alias("ami"),
        *((1 - F.col(c) / F.when(pairs > 0, pairs)).alias(name) for c, name in (("in_a", "simpson_one"), ("in_b", "simpson_two"))),
    )


def bootstrap(df: DataFrame, a: str, b: str, replicates: int = 1000) -> DataFrame:
    """(statistic, lo, hi, n): 2.5 and 97.5 percentiles of each of ``statistics_of`` over resampled rows that have both labels."""
    return intervals(contingency(df, a, b), [], statistics_of, replicates)


def agreement_panel(df: DataFrame, pairs: list[tuple[str, str]], replicates: int = 1000) -> DataFrame:
    """(one, two, levels_one, levels_two, and each of ``statistics_of`` with its interval, n) of each pair of partitions.

    adj_wallace is from the first to the second; every statistic of a pair is over the rows that have
    both labels. All pairs are one plan: their cells are counted in one pass over the rows and keyed by pair.
    """
    each = F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs))
    by = ["one", "two"]
    cells = handed_over(contingency(df.select(F.explode(each).alias("p")).select("p.*"), "a", "b", by), "cells")
    names = ["ari", "adj_wallace", "ami", "simpson_one", "simpson_two"]
    side = lambda name, end: F.max(F.when(F.col("statistic") == name, F.col(end))).alias(f"{name}_{end}")
    limits = intervals(cells, by, statistics_of, replicates).groupBy(*by).agg(*(side(name, end) for name in names for end in ("lo", "hi")))
    levels = cells.groupBy(*by).agg(F.count_distinct("a").alias("levels_one"), F.count_distinct("b").alias("levels_two"), F.sum("n").alias("n"))
    values = statistics_of(cells, by).join(limits, by).join(levels, by)
    rounded = lambda name: F.round(name, 6 if name.startswith("ami") else DIGITS).alias(name)
    return values.select(*by, "levels_one", "levels_two", *(rounded(f"{name}{end}") for name in names for end in ("", "_lo", "_hi")), "n")


def modal(df: DataFrame, within: Column, label: str) -> DataFrame:
    """One row, one column named ``label``: the commonest label of the rows within, the least of those that tie."""
    counts = df.where(within & F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    return counts.agg(F.min_by(label, F.struct(-F.col("_k"), F.col(label))).alias(label))


def classifier_panel(df: DataFrame, predictors: dict[str, Column], truth: Column) -> DataFrame:
    """One row of confusion counts and rates for each named predictor, from one pass over the rows."""
    each = F.array(*(F.struct(F.lit(name).alias("predictor"), hit.alias("hit")) for name, hit in predictors.items()))
    long = df.select(truth.alias("truth"), F.explode(each).alias("p")).select("truth", "p.*")
    return confusion(long, F.col("hit"), F.col("truth"), ["predictor"])
