"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a document's bytes, words and lines are scaled by their mean and
deviation over the corpus and mapped to cosines of random projections, which
approximate a Gaussian kernel. Each task sums its labelled rows' part of the
normal equations, Spark adds those up, and the driver solves one system of
``FEATURES`` + 1 unknowns. Rows left out of the fit calibrate it: their scores
are counted in ``BINS`` bins, and pooling adjacent violators over the bins gives
a rising curve from raw scores to probabilities.

Defined results: a null text is scored as an empty one; a text without words has
zero statistics; repeated rows are scored one by one; labels that are null or
lack a document have no effect, and repeated labels of a document count with
their mean; without any labels all scores are 0.5; input columns named like
results are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.llm.arrays import Texts, Words, mapped

FEATURES, BINS, RIDGE, SEED = 256, 1000, 1e-4, 9
#: Bytes counted together in a document's statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "mark": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "space": b" \t\n\r\v\f",
    "line": b"\n",
}
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", *(f"part_{c}" for c in CLASSES),
    "words_ending_in_mark", "words_of_mark", "words_capital", "words_second_capital", "words_repeated", "words_distinct",
]
COLUMNS = [f"_stat_{s}" for s in STATISTICS]


def _statistics(batch: pa.RecordBatch, text: str) -> dict[str, np.ndarray]:
    texts = Texts(batch.column(text))
    words = Words(texts, lower=False)
    n_bytes, n_words = np.diff(texts.at), np.diff(words.at)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)

    is_in = {}
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        is_in[name] = table
    first = texts.data[words.starts]
    second = texts.data[np.minimum(words.starts + 1, words.ends - 1)]
    last = texts.data[words.ends - 1]
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.at[:-1][n_words > 0]] = False
    distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(words.at[:-1], words.at[1:])], float)
    return {
        "log_bytes": np.log1p(n_bytes),
        "log_words": np.log1p(n_words),
        "word_bytes": per_text(words.ends - words.starts, words.at),
        **{f"part_{c}": per_text(is_in[c][texts.data], texts.at) for c in CLASSES},
        "words_ending_in_mark": per_text(is_in["mark"][last], words.at),
        "words_of_mark": per_text(is_in["mark"][last] & (words.ends - words.starts == 1), words.at),
        "words_capital": per_text(is_in["upper"][first], words.at),
        "words_second_capital": per_text(is_in["upper"][first] & is_in["upper"][second] & (words.ends - words.starts > 1), words.at),
        "words_repeated": per_text(same, words.at),
        "words_distinct": distinct / np.maximum(n_words, 1),
    }


def statistics(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with COLUMNS, one for each of STATISTICS, and without the text unless it is kept."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {f"_stat_{k}": pa.array(np.asarray(v, float)) for k, v in _statistics(batch, text).items()}

        return run

    return mapped(docs, make, ", ".join(f"{c} double" for c in COLUMNS), text, drop=() if keep_text else (text,))


@dataclass
class Model:
    """Everything a score needs; its size depends on FEATURES and BINS alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    chances: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        project = rng.standard_normal((len(STATISTICS), FEATURES)) / np.sqrt(len(STATISTICS) / 2)
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((np.cos(z @ project + shift), np.ones((len(x), 1))), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        if self.edges is None:
            return np.clip(raw, 0, 1)
        # A hair of the raw score keeps the order inside a flat step.
        return np.clip(0.999 * np.interp(raw, self.edges, self.chances) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def pooled(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing means closest to the means y / n of adjoining bins, weighted by n."""
    blocks: list[list[float]] = []
    for total, count in zip(y, n):
        blocks.append([total, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + count, blocks[-1][2] + width]
    return np.concatenate([np.full(int(w), t / c) for t, c, w in blocks])


def _matrix(pdf) -> np.ndarray:
    return pdf[COLUMNS].to_numpy(float)


def fitted(rows: DataFrame, labelled: DataFrame, label: str, calibrates: Column) -> Model:
    """A model scaled by the statistics of all ``rows`` and fitted to ``labelled`` ones.

    ``labelled`` has COLUMNS and a label from 0 to 1; rows where
    ``calibrates`` is true aren't fitted but calibrate.
    """
    moments = rows.agg(
        F.array(*(F.coalesce(F.avg(s), F.lit(0.0)) for s in COLUMNS)).alias("mean"),
        F.array(*(F.coalesce(F.stddev_pop(s), F.lit(0.0)) for s in COLUMNS)).alias("scale"),
    ).first()
    scale = np.array(moments["scale"])
    model = Model(np.array(moments["mean"]), np.where(scale > 1e-12, scale, 1.0))

    def sums(frames):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for pdf in frames:
            z = model.features(_matrix(pdf))
            total += z.T @ np.column_stack((z, pdf["_label"].to_numpy(float)))
        yield pd.DataFrame({"i": np.arange(FEATURES + 1), "row": list(total)})

    training = labelled.withColumns({"_label": F.col(label).cast("double"), "_calibrates": calibrates}).where("_label IS NOT NULL")
    slim = training.select(*COLUMNS, "_label", "_calibrates")
    parts = slim.where("NOT _calibrates").drop("_calibrates").mapInPandas(sums, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).select("i", vector_to_array("row").alias("row"))
    found = {r["i"]: r["row"] for r in summed.collect()}  # FEATURES + 1 rows
    if not found:
        return model
    normal = np.array([found[i] for i in range(FEATURES + 1)])
    count = normal[-1, -2]
    if count == 0:
        return model
    model.weights = np.linalg.solve(normal[:, :-1] + RIDGE * count * np.eye(FEATURES + 1), normal[:, -1])

    def binned(frames):
        for pdf in frames:
            raw = model.raw(_matrix(pdf))
            yield pdf[["_label"]].assign(bin=np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(int), raw=raw)

    counted = (
        slim.where("_calibrates").mapInPandas(binned, "_label double, bin int, raw double")
        .groupBy("bin").agg(F.sum("_label").alias("y"), F.count(F.lit(1)).alias("n"), F.avg("raw").alias("at"))
        .orderBy("bin").toPandas()
    )  # at most BINS rows
    if len(counted):
        model.edges = counted["at"].to_numpy(float)
        model.chances = pooled(counted["y"].to_numpy(float), counted["n"].to_numpy(float))
    return model


def scored(rows: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """Adds the score to rows that have COLUMNS, which it drops."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(frame):
        return pd.Series(sent.value.score(_matrix(frame)))

    return rows.withColumn(score, of(F.struct(*COLUMNS))).drop(*COLUMNS)
