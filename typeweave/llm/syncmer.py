"""Document fingerprints of closed syncmers.

A closed syncmer is a run of ``K`` code points whose least inner run of ``S``
code points, by hash, stands at its start or end. Whether a run is one depends
on nothing around it, so the same passage has the same anchors in any document.
A fingerprint keeps the ``ANCHORS`` anchors with the least hashes over the whole
text (fewer if it has fewer), and beyond those all with a hash up to ``ALWAYS``,
one in ``ONE_IN``, so that it grows with the text (or all anchors, where ``least`` is None); their places are kept with
them; ``;`` joins ``HASH@PLACE`` in hex, by hash. It is a sketch of all anchors, not
of a prefix. An anchor's hash takes in how often the same run was an anchor
before, so that a text of repeated passages has as many anchors as it has passages.

Two fingerprints are compared over the least hashes of their union, up to where
both are known. Anchors must match in place as well: a shared anchor counts if
one of the ``NEAR`` shared anchors before or after it stands in the same order in
both texts and about as far off (within a quarter of the way, and ``DRIFT``), so that
the shift may drift along the text and passages may move; or if its shift is one
that at least an eighth of the shared anchors agree on. The result is the Dice
ratio, 2J / (1 + J), of the estimated overlap J.

Defined results: a null text is empty; texts shorter than ``K`` have one anchor,
the whole text; the empty text has the empty fingerprint, like only itself;
repeated rows are documents of their own, and rows that are alike in all stay together;
very long texts are read whole; ids may be of any ordered type (integers are dealt out as
they are, others by their rank); other columns are left out, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeweave.llm.arrays import bounded, mixed
from typeweave.operators.offsets import placed
from typeweave.sources.tables import handed_over, shuffle_partitions

K, S, ANCHORS = 8, 3, 64
ONE_IN = 64
ALWAYS = np.uint64((1 << 48) // ONE_IN)
NEAR, DRIFT = 2, 16  # neighbours on each side; code points that the shift may change by whatever the way
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _runs(codes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n codes."""
    total = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for k in range(n):
        total *= _MULTIPLIER
        total += codes[k : k + len(total)]
    return mixed(total ^ np.uint64(seed))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of all closed syncmers of the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = codes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    if len(codes) < K:
        return _runs(codes, len(codes), 1), np.zeros(1, np.int64)
    inner = _runs(codes, S, 2)
    span = K - S + 1
    least = inner
    width = 1
    while width < span:  # minima of runs of width, doubled up to span
        step = min(width, span - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    places = np.flatnonzero((inner[: len(least)] == least) | (inner[span - 1 :] == least))
    hashes = np.zeros(len(places), np.uint64)
    for k in range(K):
        hashes = hashes * _MULTIPLIER + codes[places + k]
    return mixed(hashes ^ np.uint64(3)), places


def _times_before(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes stand before each, so that a passage counts as often as it occurs."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(hashes) else order
    times = np.empty(len(hashes), np.uint64)
    times[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return times


def sketch(text: str, least: int | None = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The ``least`` distinct hashes that are the smallest, at 48 bits, and all others up to ALWAYS, with the first place of each; with None all anchors."""
    hashes, places = anchors(text)
    hashes = mixed(hashes + _times_before(hashes)) >> np.uint64(16)
    if least is None:
        hashes, first = np.unique(hashes, return_index=True)
        return hashes, places[first]
    if len(hashes) > 4 * least:  # the least few, and those that tie with the last of them
        few = hashes <= max(np.partition(hashes, 2 * least)[2 * least], ALWAYS)
        if len(np.unique(hashes[few])) >= least:
            hashes, places = hashes[few], places[few]
    hashes, first = np.unique(hashes, return_index=True)
    kept = max(least, int(np.searchsorted(hashes, ALWAYS, "right")))
    return hashes[:kept], places[first[:kept]]


def written(a: tuple[np.ndarray, np.ndarray]) -> str:
    return ";".join(f"{h:012x}@{p:x}" for h, p in zip(a[0].tolist(), a[1].tolist()))


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split("@") for x in fingerprint.split(";")] if fingerprint else []
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p, 16) for _, p in pairs], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: int | None = ANCHORS) -> float:
    """Of two sketches, from 0 to 1; ``least`` as they were made with."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    # Only where neither sketch is full are all anchors known beyond its last, or beyond ALWAYS.
    full = [max(x[0][-1], ALWAYS) for x in (a, b) if least is not None and len(x[0]) >= least]
    union = np.union1d(a[0], b[0])
    if full:
        union = union[union <= min(full)]
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    seen = both <= union[-1]
    overlap = int(_placed(a[1][at_a][seen], b[1][at_b][seen]).sum()) / len(union)
    return 2 * overlap / (1 + overlap)


def _placed(at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Which of the shared anchors match in place."""
    if not len(at_a):
        return np.zeros(0, bool)
    order = np.argsort(at_a, kind="stable")
    at_a, at_b = at_a[order], at_b[order]
    _, which, times = np.unique(at_a - at_b, return_inverse=True, return_counts=True)
    placed = times[which] * 8 >= len(at_a)
    for k in range(1, NEAR + 1):
        way_a, way_b = at_a[k:] - at_a[:-k], at_b[k:] - at_b[:-k]
        fit = (way_b > 0) & (np.abs(way_a - way_b) <= DRIFT + np.maximum(way_a, way_b) // 4)
        placed[k:] |= fit
        placed[:-k] |= fit
    return placed


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", least: int | None = ANCHORS) -> DataFrame:
    """Adds the fingerprint of each text; of all its anchors where ``least`` is None."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: written(sketch(t or "", least)))

    return bounded(docs).withColumn(out, run(text))


def likeness_of(a: str, b: str, least: int | None = ANCHORS) -> Column:
    """Of two columns of fingerprints, made with ``least``."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(read(f), read(g), least) for f, g in zip(x, y)], dtype=float)

    return run(a, b)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many code points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def against_next(docs: DataFrame, row_id: str, text: str, parts: int | None = None, least: int | None = ANCHORS) -> DataFrame:
    """One row per document, compared with the next one and with a text edited by it.

    The next document has the next lower id, and the highest comes after the
    lowest. Rows are dealt out by ranges of the id, each range with one more
    row: the first of the range below. Within a range the next document is the
    row after, so that every text is shuffled once and no window sees all rows.
    Null ids come last; equal ids are in the order of their texts' hashes, and where
    one id fills several ranges, or is null, these are ranges of the hash.
    """
    spark = docs.sparkSession
    parts = parts or 4 * shuffle_partitions(spark)
    if not isinstance(docs.schema[row_id].dataType, T.IntegralType):
        ids = docs.select(F.col(row_id).alias("id")).where("id IS NOT NULL").distinct()
        ids = handed_over(placed(ids, [], ["id"], "number"), "fingerprint-ids")
        texts = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).join(ids, "id", "left").select("number", "text")
        return against_next(texts, "number", "text", parts, least).join(ids, F.col("row_id") == F.col("number"), "left").select(F.col("id").alias("row_id"), *_COMPARED[1:])
    slim = docs.select(F.col(row_id).cast("long").alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    quantiles = F.percentile_approx("row_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))
    cuts = np.array(sorted(slim.agg(quantiles).first()[0] or []), np.int64)  # fewer than parts; an id with many rows is several

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        part = ties.to_numpy(np.int64) / 2.0**64 + 0.5  # rises with the hash, from 0 to 1
        at = len(cuts) + parts - np.minimum(part * parts, parts - 1).astype(np.int64)
        value = ids[known].to_numpy(np.int64)
        low, high = np.searchsorted(cuts, value, "left"), np.searchsorted(cuts, value, "right")
        several = np.maximum(high - low, 1)
        at[known] = len(cuts) - high + several - 1 - np.minimum(part[known] * several, several - 1).astype(np.int64)
        return pd.Series(at)

    keyed = slim.withColumn("tie", F.xxhash64("text")).withColumn("range", range_of("row_id", "tie"))
    order = F.struct(F.col("row_id").isNotNull().alias("known"), "row_id", "tie")
    heads = keyed.groupBy("range").agg(F.max(order).alias("head")).orderBy("range").collect()  # at most 2 * parts rows
    # The first row of each range also ends the range before it, the first of all the last range.
    also = spark.createDataFrame(
        [(h["range"], h["head"]["row_id"], h["head"]["tie"], heads[k - 1]["range"]) for k, h in enumerate(heads)],
        "range int, head_id long, head_tie long, also int",
    )
    is_head = F.col("row_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own, extra = F.struct("range", F.lit(False).alias("extra")), F.struct(F.col("also").alias("range"), F.lit(True).alias("extra"))
    dealt = (
        keyed.join(F.broadcast(also), "range")
        .select("row_id", "text", "tie", F.explode(F.when(is_head, F.array(own, extra)).otherwise(F.array(own))).alias("to"))
        .select("row_id", "text", "tie", "to.range", "to.extra")
        .repartition(shuffle_partitions(spark), "range")
        .sortWithinPartitions("range", "extra", F.col("row_id").desc_nulls_last(), F.col("tie").desc())
        .select("row_id", "text", "range", "extra")
    )

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for frame in frames:
            out = []
            for row_id, text, at, is_extra in frame.itertuples(index=False, name=None):
                if waiting is None and is_extra:
                    continue  # a repeated row was the head
                own = sketch(text, least)
                if waiting is not None:
                    out.append(_compared(*waiting, text, own, least))
                waiting = None if is_extra else (row_id, text, own)
            yield pd.DataFrame(out, columns=_COMPARED).astype({"row_id": "Int64"})

    return bounded(dealt).mapInPandas(follow, "row_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_COMPARED = ["row_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(row_id, text: str, own, following: str, its, least: int | None) -> tuple:
    other = edited(text, following)
    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    its_edited = sketch(other, least)
    return (row_id if pd.notna(row_id) else None, len(text), sha, written(own), written(its_edited), likeness(own, its_edited, least), likeness(own, its, least))
