"""Bootstrap of any statistic of two partitions, drawn by cells of their contingency table.

Rows drawn with replacement fall into the cells as a multinomial, which is drawn by
splitting a binary tree over the cells in the order of their labels: at each inner node the
draws are dealt to its left half by a binomial. A replicate costs one draw a cell, however many
rows the cells count. The tree is cut into blocks of ``BLOCK`` cells; a block walks down
from the root by the totals on its path and then splits itself, so that blocks and
replicates are independent tasks and no task holds more than one block.

The uniform number of a split comes from its replicate and node by two rounds of 32-bit
mixing, which any engine with 64-bit integers repeats, and gives the binomial's quantile. A
split of more than ``EXACT`` draws takes numpy's binomial instead, seeded by the same number; both
are exact binomials.

A statistic is any function of a DataFrame of drawn cells (by..., rep, a, b, n);
``partition.statistics_of`` has those of the panels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.operators.offsets import placed
from typeweave.sources.tables import handed_over, shuffle_partitions

BLOCK_BITS, EXACT, REPLICATES = 12, 1 << 12, 1000
BLOCK = 1 << BLOCK_BITS
TOGETHER = 125  # replicates that a task draws at once

_LOGS = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, EXACT + 1)))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers; all products stay below 2**63."""
    x = x ^ (x >> 16)
    x = (x * 0x21F0AAAD) & 0xFFFFFFFF
    x = x ^ (x >> 15)
    x = (x * 0x735A2D97) & 0xFFFFFFFF
    return x ^ (x >> 15)


def uniform(rep: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each replicate and node."""
    first = _mix(_mix(rep.astype(np.int64) + 1) ^ (node & 0xFFFFFFFF)) ^ (node >> 32)
    high, low = _mix(first), _mix(first ^ 0x5BF03635)
    return (high * 2.0**21 + (low >> 11) + 0.5) / 2.0**53


def binomial(trials: np.ndarray, part: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The binomial quantile of u for each (trials, part); part is between 0 and 1."""
    out = np.where(part >= 1, trials, 0)
    for k in np.flatnonzero((trials > EXACT) & (part > 0) & (part < 1)):
        out[k] = np.random.default_rng(int(u[k] * 2.0**53)).binomial(trials[k], part[k])
    left = np.flatnonzero((trials > 0) & (trials <= EXACT) & (part > 0) & (part < 1))
    t, p, goal = trials[left], part[left], u[left]
    mean = t * p
    k = np.maximum(np.floor(mean - 10 * np.sqrt(mean * (1 - p)) - 10), 0).astype(np.int64)
    mass = np.exp(_LOGS[t] - _LOGS[k] - _LOGS[t - k] + k * np.log(p) + (t - k) * np.log1p(-p))
    upto, odds = mass.copy(), p / (1 - p)
    while len(left):
        done = (upto >= goal) | (k >= t)
        out[left[done]] = k[done]
        if done.any():
            rest = ~done
            left, t, goal, k, mass, upto, odds = (x[rest] for x in (left, t, goal, k, mass, upto, odds))
        mass = mass * ((t - k) / (k + 1) * odds)
        k = k + 1
        upto = upto + mass
    return out


def _split(trials: np.ndarray, counts: np.ndarray, reps: np.ndarray, node: int) -> np.ndarray:
    """(cells, replicates) draws of a subtree whose root ``node`` got ``trials``; the number of counts is a power of two."""
    levels = [counts]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    drawn = trials[None, :]
    for below in levels[-2::-1]:
        total, first = below.reshape(-1, 2).sum(axis=1), below[::2]
        nodes = node + np.arange(len(total))
        some = np.flatnonzero(drawn.reshape(-1) > 0)
        row, column = np.divmod(some, len(reps))
        taken = np.zeros(drawn.size, np.int64)
        taken[some] = binomial(drawn.reshape(-1)[some], first[row] / total[row], uniform(reps[column], nodes[row]))
        taken = taken.reshape(drawn.shape)
        drawn = np.stack((taken, drawn - taken), axis=1).reshape(-1, len(reps))
        node *= 2
    return drawn


def resampled(cells: DataFrame, by: list[str], replicates: int = REPLICATES) -> DataFrame:
    """(by..., rep, a, b, n): the cells of each replicate, with labels as numbers (the least cell of a label).

    ``cells`` is a contingency table (by..., a, b, n) without nulls in ``by``; all groups are drawn in one plan.
    """
    cells = handed_over(placed(cells, by, ["a", "b"], "cell"), "cells") if by else handed_over(placed(cells.withColumn("_all", F.lit(0)), ["_all"], ["a", "b"], "cell"), "cells")
    keys = by or ["_all"]
    number = lambda c: cells.groupBy(*keys, c).agg(F.min("cell").alias(f"_{c}"))
    numbered = cells.join(number("a"), [*keys, "a"]).join(number("b"), [*keys, "b"]).withColumn("block", F.shiftright("cell", BLOCK_BITS))
    blocks = numbered.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("cell", "_a", "_b", "n"))).alias("held"), F.sum("n").alias("total"))
    blocks = handed_over(blocks, "cell-blocks")
    # The levels above blocks are the same for all of a group: as many as its number of cells needs.
    sizes = cells.groupBy(*keys).agg(F.max("cell").alias("_last"), F.sum("n").alias("rows"))
    depth = F.when(F.col("_last") > 0, F.floor(F.log2(F.col("_last").cast("double"))) + 1).otherwise(0)
    above = F.greatest(depth - BLOCK_BITS, F.lit(0)).cast("int")
    known = blocks.join(sizes.select(*keys, "rows", above.alias("above"), F.least(depth, F.lit(BLOCK_BITS)).cast("int").alias("below")), keys)
    each = known.select(*keys, "block", "total", "above", F.explode(F.sequence(F.lit(0), F.col("above"))).alias("up"))
    each = each.withColumn("_node", F.expr("shiftright(block, up)"))
    sums = each.groupBy(*keys, "up", "_node").agg(F.sum("total").alias("t"))
    path = each.join(sums, [*keys, "up", "_node"]).groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("up", "t"))), lambda x: x["t"]).alias("path"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // TOGETHER))).alias("chunk")
    dealt = handed_over(known.join(path, [*keys, "block"]).select(*keys, "block", "rows", "above", "below", "path", "held"), "cell-blocks")
    # With a number, as partitions of few bytes would else be put together.
    work = dealt.select("*", chunks).repartition(shuffle_partitions(cells.sparkSession), F.xxhash64(*keys, "block", "chunk"))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("block", "rows", "above", "below", "path", "held", "chunk")}
                held = row["held"].values
                cell, a, b, n = (held.field(c).to_numpy() for c in ("cell", "_a", "_b", "n"))
                above, below, block, path = row["above"].as_py(), row["below"].as_py(), row["block"].as_py(), row["path"].values.to_numpy()
                reps = np.arange(row["chunk"].as_py() * TOGETHER, min((row["chunk"].as_py() + 1) * TOGETHER, replicates))
                trials, node = np.full(len(reps), row["rows"].as_py()), 1
                for up in range(above, 0, -1):
                    right = block >> (up - 1) & 1
                    total, child = path[up], path[up - 1]
                    first = total - child if right else child
                    got = binomial(trials, np.full(len(reps), first / total), uniform(reps, np.full(len(reps), node)))
                    trials, node = (trials - got if right else got), 2 * node + right
                counts = np.zeros(1 << below, np.int64)
                counts[cell - (block << BLOCK_BITS)] = n
                drawn = _split(trials, counts, reps, node)[cell - (block << BLOCK_BITS)]
                i, j = np.nonzero(drawn)
                same = {c: pa.array([batch.column(c)[k].as_py()] * len(i), batch.column(c).type) for c in names}
                yield pa.RecordBatch.from_arrays([*same.values(), pa.array(reps[j], pa.int32()), pa.array(a[i], pa.int64()), pa.array(b[i], pa.int64()), pa.array(drawn[i, j], pa.int64())], [*names, "rep", "a", "b", "n"])

    schema = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in names) + ", rep int, a bigint, b bigint, n bigint"
    return work.mapInArrow(run, schema)


def intervals(cells: DataFrame, by: list[str], statistics: Callable[[DataFrame, list[str]], DataFrame], replicates: int = REPLICATES) -> DataFrame:
    """(by..., statistic, lo, hi, n): 2.5 and 97.5 percentiles of each column that ``statistics`` gives beside (by..., rep), and how many replicates have a value."""
    keys = by or ["_all"]
    values = statistics(resampled(cells, by, replicates), [*keys, "rep"])
    names = [c for c in values.columns if c not in (*keys, "rep")]
    long = values.unpivot([*keys], names, "statistic", "value").where("value IS NOT NULL AND NOT isnan(value)")
    both = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    found = long.groupBy(*keys, "statistic").agg(both.alias("p"), F.count(F.lit(1)).alias("n"))
    return found.select(*by, "statistic", F.round(F.get("p", 0), 8).alias("lo"), F.round(F.get("p", 1), 8).alias("hi"), "n")
