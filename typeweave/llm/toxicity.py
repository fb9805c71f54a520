"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a run of letters and digits. Its log-odds come from the labelled texts'
counts under Dirichlet priors in a chain: the prior of a token is the posterior of
its beginning of six bytes, that one's of five, and so on down to three, whose prior
is the corpus; so an unseen form of a known stem inherits the stem's odds, and what
is rare stays near its prior. Counts are kept in a table of ``BUCKETS`` hashed
cells, whose size is a parameter and not the data's. The score of a token is its
log-odds, moved towards zero by ``CAUTION`` standard deviations, less ``DRIFT``.

A scan in linear time finds all maximal segments of a text (no segment can be made
better by longer or shorter bounds); runs of tokens of one sign are summed first, so
that only runs are walked. Chance scores of the best segment have an extreme-value
distribution: lambda solves mean(exp(lambda * score)) = 1 over tokens of clean
labelled texts, and ln K is moved to their segments. A segment is significant where
fewer than ``CHANCE`` as good are expected in a text of that length; the sum of the
surpluses of all of them is the text's statistic, which a logistic curve turns into a
score. Odds that calibrate never come from the same text: labelled texts are dealt
into two halves, and each is scored by the other half's counts.

Defined results: a null text is an empty one; a text without tokens has no passages and the
score of the statistic 0; repeated rows are scored one by one; repeated labels of a
document count each; labels that are null or lack a document have no effect; without
labels of both kinds every score is the share of toxic ones (0 without any); input
columns named like results are replaced; whole texts are scanned, however long; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.llm.arrays import Texts, bounded, mapped, mixed, pieces, released, span_hashes
from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over

BUCKETS = 1 << 20
STEMS = (3, 4, 5, 6)  # bytes of the beginnings that lend a token its prior
PRIOR, CAUTION, DRIFT = 3.0, 1.0, 0.4
#: The fit reads about so many labelled rows, taken by a hash of their id, or all if there are fewer.
FIT_ROWS = 500_000
CHANCE = 0.01
GRID = np.concatenate(([0.0], np.geomspace(0.02, 4.0, 63)))
SHRINK, STEPS, BINS = 0.05, 60, 1000

_CODE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z in small letters, and the capitals of U+00C0 to U+00DE."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return data


class Tokens:
    """Tokens of some texts: bounds in bytes, the first of each text, distinct ones by number, and their hashed cells (a row for each of STEMS and one for the whole)."""

    def __init__(self, texts: Texts) -> None:
        inside, n = _INSIDE[texts.data], len(texts.data)
        first = np.ones(n, bool)
        first[1:] = ~inside[:-1]
        first[texts.at[(texts.at > 0) & (texts.at < n)]] = True
        last = np.ones(n, bool)
        last[:-1] = ~inside[1:]
        last[texts.at[(texts.at > 0) & (texts.at < n)] - 1] = True
        self.starts, self.ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
        self.at = np.searchsorted(self.starts, texts.at)
        codes = _CODE[_lower(texts.data)]
        hashes = span_hashes(codes, self.starts, self.ends)
        _, one, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = self.starts[one], self.ends[one]
        kinds = [span_hashes(codes, a, np.minimum(a + size, b)) + np.uint64(size) for size in STEMS] + [hashes[one]]
        self.cells = np.stack([(mixed(k) % np.uint64(BUCKETS)).astype(np.int64) for k in kinds])


@dataclass
class Odds:
    """Counts of cells in toxic and in clean texts, and the tokens of each."""

    toxic: np.ndarray
    clean: np.ndarray
    tokens: tuple[int, int]

    def scores(self, cells: np.ndarray) -> np.ndarray:
        base = np.log(self.tokens[0] / self.tokens[1])
        prior = np.full(cells.shape[1], self.tokens[0] / sum(self.tokens))
        for level in cells:
            y, z = self.toxic[level] + PRIOR * prior, self.clean[level] + PRIOR * (1 - prior)
            prior = y / (y + z)
        odds = np.log(y / z) - base
        sure = np.sqrt(1 / (y + 0.5) + 1 / (z + 0.5))
        return np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * sure, 0) - DRIFT


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal-scoring runs of positive total, in order; time grows with the length."""
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        now = (before, total, k, k + 1)
        while kept:
            # Candidates whose start is not below this one's can never be joined to it.
            back = len(kept) - 1
            while back >= 0 and kept[back][0] >= now[0]:
                back -= 1
            if back < 0 or kept[back][1] >= now[1]:
                break
            now = (kept[back][0], now[1], kept[back][2], now[3])
            del kept[back:]
        kept.append(now)
    return [(after - before, a, b) for before, after, a, b in kept]


def _segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """``maximal_segments`` of single tokens' scores, walked by runs of one sign."""
    if not len(scores) or scores.max() <= 0:
        return []
    up = scores > 0
    starts = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
    ends = np.append(starts[1:], len(scores))
    return [(s, int(starts[a]), int(ends[b - 1])) for s, a, b in maximal_segments(np.add.reduceat(scores, starts).tolist())]


@dataclass
class Model:
    """Everything a score needs; its size depends on BUCKETS alone."""

    odds: Odds | None
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    base: float = 0.0

    def score(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * statistic, -30, 30)))


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(key, n) over ``docs``, which has _half and _toxic: a key is (2 * half + toxic) * (BUCKETS + 1) + cell + 1, or without a cell for the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                tokens = Tokens(Texts(piece.column(text)))
                group = piece.column("_half").to_numpy() * 2 + piece.column("_toxic").to_numpy()
                of_token = np.repeat(group, np.diff(tokens.at)).astype(np.int64)
                found = [of_token * (BUCKETS + 1)] + [of_token * (BUCKETS + 1) + level[tokens.number] + 1 for level in tokens.cells]
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])
        released()

    return bounded(docs).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _scanned(docs: DataFrame, text: str, odds: list[Odds], half: str | None, moments: bool, drop: tuple[str, ...]) -> DataFrame:
    """Adds _tokens and _found (segments by bytes), and _moments: sums of exp(GRID * score); a row with half h is scored by odds[1 - h]."""
    sent = docs.sparkSession.sparkContext.broadcast(odds)

    def make():
        odds = sent.value

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = Texts(batch.column(text))
            tokens = Tokens(texts)
            by_odds = [o.scores(tokens.cells)[tokens.number] for o in odds]
            which = 1 - batch.column(half).to_numpy() if half else np.zeros(len(texts), int)
            found, sums = [], []
            for k, (a, b) in enumerate(zip(tokens.at[:-1], tokens.at[1:])):
                scores = by_odds[which[k]][a:b]
                first = texts.at[k]
                found.append([{"score": s, "start": int(tokens.starts[a + i] - first), "end": int(tokens.ends[a + j - 1] - first)} for s, i, j in _segments(scores)])
                if moments:
                    values, times = np.unique(np.round(scores, 2), return_counts=True)
                    sums.append(times @ np.exp(np.outer(values, GRID)))
            out = {"_tokens": pa.array(np.diff(tokens.at), pa.int64()), "_found": pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))}
            return out | ({"_moments": pa.array(sums, pa.list_(pa.float64()))} if moments else {})

        return run

    return mapped(docs, make, "_tokens bigint, _found array<struct<score: double, start: bigint, end: bigint>>" + (", _moments array<double>" if moments else ""), text, drop)


def _significant(found: Column, tokens: Column, model: Model) -> Column:
    """The segments that chance doesn't explain, with their expected number as good."""
    each = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), (model.lam * s["score"] - model.log_k - F.ln(F.greatest(tokens, F.lit(1)))).alias("surplus")))
    return F.filter(each, lambda s: s["surplus"] > -np.log(CHANCE))


def _statistic(spans: Column) -> Column:
    return F.ln(1 + F.aggregate(spans, F.lit(0.0), lambda t, s: t + s["surplus"] + float(np.log(CHANCE))))


def fitted(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the labelled rows of ``docs``; ``labels`` has (row_id, label) without those that must not be seen."""
    labels = labels.where(F.col(row_id).isNotNull() & F.col(label).isNotNull()).select(F.col(row_id).alias("_id"), F.when(F.col(label) > 0, 1).otherwise(0).alias("_toxic"))
    rows = labels.count()
    if rows > FIT_ROWS:
        labels = labels.where(F.pmod(F.xxhash64("_id"), F.lit(rows)) < FIT_ROWS)
    if rows == 0:
        return Model(None, base=-30.0)
    slim = docs.select(F.col(row_id).alias("_id"), F.col(text).alias("text"))
    labelled = slim.join(F.broadcast(labels), "_id")  # about FIT_ROWS ids at most
    labelled = handed_over(labelled.select("text", "_toxic", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int").alias("_half")), "labelled-texts")
    counted = _counts(labelled, "text").select(F.col("key").cast("int"), F.col("n").cast("double")).toArrow()  # at most 4 * (BUCKETS + 1) pairs
    table = np.zeros(4 * (BUCKETS + 1), np.float32)
    table[counted["key"].to_numpy()] = counted["n"].to_numpy()
    del counted
    table = table.reshape(4, -1)
    make = lambda clean, toxic: Odds(toxic[1:], clean[1:], (int(toxic[0]), int(clean[0])))
    halves, whole = [make(table[0], table[1]), make(table[2], table[3])], make(table[0] + table[2], table[1] + table[3])
    if not all(whole.tokens):
        share = labels.agg(F.avg("_toxic")).first()[0]
        return Model(None, base=float(np.clip(np.log(share / (1 - share)), -30, 30)) if 0 < share < 1 else 30.0 * (2 * (share or 0) - 1))
    if not all(h.tokens[0] and h.tokens[1] for h in halves):
        halves = [whole, whole]
    scanned = handed_over(_scanned(labelled, "text", halves, "_half", True, ("text",)).drop("_half"), "labelled-segments")
    clean = scanned.where("_toxic = 0 AND _tokens > 0")
    total = clean.agg(Summarizer.sum(array_to_vector("_moments")).alias("m"), F.sum("_tokens").alias("n")).select(vector_to_array("m").alias("m"), "n").first()
    model = Model(whole, *_chance(np.array(total["m"]) / total["n"]))
    # ln K moves the mean of the best chance segments to that of their distribution.
    best = clean.where(F.size("_found") > 0).select((model.lam * F.array_max(F.transform("_found", lambda s: s["score"])) - F.ln("_tokens")).alias("x"))
    model.log_k = float(min((best.agg(F.percentile("x", F.lit(0.5))).first()[0] or 0.0), 0.0))
    statistic = F.floor(_statistic(_significant(F.col("_found"), F.col("_tokens"), model)) * (BINS / 10)).alias("bin")
    bins = scanned.groupBy(statistic).agg(F.sum("_toxic").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()  # one row a bin
    model.slope, model.base = _logistic((bins["bin"].to_numpy(float) + 0.5 * (bins["bin"] > 0)) * 10 / BINS, bins["y"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def _chance(moments: np.ndarray) -> tuple[float]:
    """lambda where the mean of exp(lambda * score) comes back to 1."""
    above = np.flatnonzero((moments[1:] >= 1) & (GRID[1:] > 0.02)) + 1
    if not len(above):
        return (float(GRID[-1]),)
    k = above[0]
    low, high = np.log(moments[k - 1]), np.log(moments[k])
    return (float(GRID[k] if high == low or low > 0 else GRID[k - 1] + (GRID[k] - GRID[k - 1]) * -low / (high - low)),)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, base) of a curve through counted bins, by Newton's steps with a small penalty on the slope."""
    design, w = np.column_stack((x, np.ones_like(x))), np.zeros(2)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        pull = design.T @ (y - n * p) - SHRINK * w * [1, 0]
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([SHRINK, 1e-6]), pull)
        w = w + np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score", spans: str = "toxic_spans", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` and ``spans``: (start, end, score, surplus) of each significant passage, by bytes, in order."""
    kept = [c for c in docs.columns if c not in (score, spans)]
    drop = () if keep_text else (text,)
    if model.odds is None:
        empty = F.array().cast("array<struct<start: bigint, end: bigint, score: double, surplus: double>>")
        return docs.select(*(c for c in kept if c not in drop), F.lit(float(model.score(np.zeros(1))[0])).alias(score), empty.alias(spans))
    inner = unused([*docs.columns, score, spans], "_tokens", "_found")
    aside = dict(zip([c for c in docs.columns if c in ("_tokens", "_found")], unused([*docs.columns, *inner], "_aside_a", "_aside_b")))
    found = _scanned(docs.select(kept).withColumnsRenamed(aside), text, [model.odds], None, False, drop)
    back = [F.col(aside.get(c, c)).alias(c) for c in kept if c not in drop]
    passages = _significant(F.col("_found"), F.col("_tokens"), model)
    out = found.withColumn(inner[1], passages).select(*back, inner[1])  # one after the other, as a column of the input may be named like one that passages reads
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.base + model.slope * _statistic(F.col(inner[1]))))))
    return out.select(*(c for c in kept if c not in drop), value.alias(score), F.col(inner[1]).alias(spans))
