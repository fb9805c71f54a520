"""Sequence and table preparation: quality figures, slices, concatenation, best hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITES, PLANES, CHARACTERS = 1024, 256, 1 << 20
LOW, HIGH = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_upper(text: Column) -> Column:
    """A-Z for a-z and nothing else: other letters change their length in some engines. Texts without other letters take the quicker way."""
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(F.translate(text, LOW, HIGH))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def n50(pieces: DataFrame, key: str, length: str) -> DataFrame:
    """(key, total, pieces, n50): the length at which the longest pieces first hold half of the total.

    Lengths are counted first, so that the running sum sees distinct lengths only.
    """
    counts = pieces.where(F.col(length).isNotNull()).groupBy(key, length).agg(F.count(F.lit(1)).alias("_k"))
    totals = counts.groupBy(key).agg(F.sum(F.col("_k") * F.col(length)).alias("total"), F.sum("_k").alias("pieces"))
    upto = F.sum(F.col("_k") * F.col(length)).over(Window.partitionBy(key).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto", upto).join(totals, key).where(2 * F.col("upto") >= F.col("total"))
    return reached.groupBy(key).agg(F.max(length).alias("n50"), F.first("total").alias("total"), F.first("pieces").alias("pieces")).select(key, "total", "pieces", "n50")


def quality(pieces: DataFrame, key: str, seq: str, low: int, high: int, least_n50: int) -> DataFrame:
    """(key, total_bp, contigs, n50, gc_pct, status) of each set of sequences; all bounds inclusive."""
    without = F.col(seq)
    for base in "GCgc":
        without = F.replace(without, F.lit(base), F.lit(""))
    measured = pieces.select(key, F.length(seq).cast("bigint").alias("length"), (F.length(seq) - F.length(without)).cast("bigint").alias("gc"))
    gc = measured.groupBy(key).agg(F.sum("gc").alias("gc"))
    good = F.col("total").between(low, high) & (F.col("n50") >= least_n50)
    return (
        n50(measured, key, "length").join(gc, key)
        .select(
            key, F.col("total").alias("total_bp"), F.col("pieces").alias("contigs"), "n50",
            F.round(F.when(F.col("total") > 0, 100 * F.col("gc") / F.col("total")).otherwise(0.0), 6).alias("gc_pct"),
            F.when(good, "PASS").otherwise("FAIL").alias("status"),
        )
    )


def slice_with_strand(seq: Column, start: Column, end: Column) -> Column:
    """Code points start to end, 1-based and inclusive; reversed and complemented where start is beyond end."""
    low, high = F.least(start, end), F.greatest(start, end)
    part = F.substring(seq, low, high - low + 1)
    return F.when(start <= end, part).otherwise(F.translate(F.reverse(part), "ACGTacgt", "TGCAtgca"))


def partitions(blocks: DataFrame, order: str, length: str) -> DataFrame:
    """Adds first and last, 1-based and inclusive: where each block stands when all are joined. Blocks are loci, so few."""
    upto = F.sum(length).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("last", upto).withColumn("first", F.col("last") - F.col(length) + 1)


def concatenated(blocks: DataFrame, key: str, order: str, seq: str, lengths: DataFrame | None = None) -> DataFrame:
    """(key, seq): each key's blocks joined in order.

    Where ``lengths`` (order, length) is given, every key has a block of each
    order it names, and one that a key lacks is filled with N.
    """
    if lengths is None:
        whole = blocks.select(key, F.col(order).alias("o"), F.coalesce(F.col(seq), F.lit("")).alias("s"))
    else:
        # One row a key, then each wanted order is looked up in it: loci are few.
        own = blocks.where(F.col(seq).isNotNull()).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(order), F.col(seq)))).alias("own"))
        wanted = lengths.agg(F.collect_list(F.struct(F.col(order).alias("o"), F.col("length"))).alias("wanted"))
        each = blocks.select(key).distinct().join(own, key, "left").crossJoin(wanted).select(key, "own", F.explode("wanted").alias("w"))
        whole = each.select(key, F.col("w.o").alias("o"), F.coalesce(F.try_element_at("own", F.col("w.o")), F.repeat(F.lit("N"), F.col("w.length").cast("int"))).alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("o", "s")))
    return whole.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("seq"))


def last_matching(lines: DataFrame, key: str, position: str, line: str, pattern: str) -> DataFrame:
    """(key, line): of each key's lines that match the pattern, the last by position."""
    return lines.where(F.col(line).rlike(pattern)).groupBy(key).agg(F.max_by(line, position).alias(line))


def informative_sites(rows: DataFrame, seq: str) -> DataFrame:
    """(site, states, informative): a site is informative if two states or more each stand in two rows or more.

    Sites are 0-based code points, and all are counted. Sites are cut into blocks of ``SITES``; each task counts a
    block's states in planes, one vector of counts for each block and state, and Spark adds vectors up, so there is no row for a character.
    """

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            start = 0
            while start < len(texts):  # about CHARACTERS at once, or one longer text
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHARACTERS):
                    size += len(texts[stop])
                    stop += 1
                codes = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                codes[(codes >= 97) & (codes <= 122)] -= 32
                lengths = np.array([len(t) for t in texts[start:stop]])
                site = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                key, plane = np.unique((site // SITES << 21) | codes, return_inverse=True)
                for low in range(0, len(key), PLANES):
                    here = (plane >= low) & (plane < low + PLANES)
                    counts = np.bincount((plane[here] - low) * SITES + site[here] % SITES, minlength=len(key[low : low + PLANES]) * SITES)
                    offsets = pa.array(np.arange(0, len(counts) + 1, SITES, dtype=np.int32))
                    some = key[low : low + PLANES]
                    yield pa.RecordBatch.from_arrays([pa.array(some >> 21), pa.array(some & 0x1FFFFF), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.float64)))], ["block", "state", "counts"])
                start = stop

    made = rows.select(F.col(seq).alias("text")).mapInArrow(planes, "block bigint, state bigint, counts array<double>")
    summed = made.groupBy("block", "state").agg(vector_to_array(Summarizer.sum(array_to_vector("counts"))).alias("n"))
    flags = lambda least: Summarizer.sum(array_to_vector(F.transform("n", lambda x: (x >= least).cast("double"))))
    by_block = summed.groupBy("block").agg(vector_to_array(flags(1)).alias("states"), vector_to_array(flags(2)).alias("often"))
    each = by_block.select("block", F.posexplode(F.arrays_zip("states", "often")).alias("at", "s")).where("s.states > 0")
    return each.select((F.col("block") * SITES + F.col("at")).cast("int").alias("site"), F.col("s.states").cast("bigint").alias("states"), (F.col("s.often") >= 2).alias("informative"))


def best_hit(hits: DataFrame, query: str, length: Column, wanted: Column, score: str, position: str) -> DataFrame:
    """Each query's hit of highest positive score whose length is within half and one and a half of the wanted; first position wins ties."""
    fit = hits.where(length.between(0.5 * wanted, 1.5 * wanted) & (F.col(score) > 0))
    rest = [c for c in hits.columns if c != query]
    best = fit.groupBy(query).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(position))).alias("hit"))
    return best.select(query, "hit.*")
