"""Arrow batches of texts as flat numpy arrays.

Helpers for functions that run inside tasks. A batch is handled in pieces of
about ``PIECE_BYTES`` of text, so that temporaries stay bounded; only a single
longer text makes a larger piece, as whole texts are never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PIECE_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
#: The white space that separates words: space and U+0009 to U+000D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(0x7E55)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The same with A-Z as a-z.
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_SLOT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def bounded(df: DataFrame) -> DataFrame:
    """``df``; Arrow batches of its session hold about BATCH_BYTES from here on (or one longer row), as they are else bounded by rows of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


class Texts:
    """The UTF-8 bytes of some texts, one after another; nulls are empty."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        first, last = int(self.at[0]), int(self.at[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
        self.at = self.at - first

    def __len__(self) -> int:
        return len(self.at) - 1


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PIECE_BYTES of text in ``column``."""
    texts = Texts(batch.column(column))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(texts.at, texts.at[start] + PIECE_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield batch.slice(start, stop - start)
        start = stop


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], added: str, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop``, with the columns of schema ``added`` from each piece of rows.

    ``make`` is called once in each task and gives the function for pieces. An
    input column named like an added one is replaced.
    """
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema if f.name not in drop and f.name not in new.names]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for piece in pieces(batch, text):
                made = function(piece)
                yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + [made[n] for n in new.names], names + new.names)
        released()

    return bounded(df).mapInArrow(run, T.StructType(kept + new.fields))


def released() -> None:
    """Gives what a task has freed back to the system: Python workers are kept for later tasks, beside which it would still count."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, _kept: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]) -> tuple[np.ndarray, np.ndarray]:
    if len(_kept[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _kept[k] = np.cumprod(np.array([1, *[base] * (size - 1)], np.uint64), dtype=np.uint64)
    return _kept[0], _kept[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many spans, from one running sum.

    Equal spans hash alike wherever they stand: the sum of code * BASE**place is
    divided by BASE**start, modulo 2**64.
    """
    up, down = _powers(len(codes) + 1)
    running = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=running[1:])
    return mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of texts: starts, ends and hashes, and the first word of each text in ``at``."""

    def __init__(self, texts: Texts, lower: bool = True) -> None:
        space = _IS_SPACE[texts.data]
        n = len(space)
        inner = texts.at[(texts.at > 0) & (texts.at < n)]
        fresh = np.ones(n, bool)
        fresh[1:] = space[:-1]
        fresh[inner] = True
        self.starts = np.flatnonzero(fresh & ~space)
        over = np.ones(n, bool)
        over[:-1] = space[1:]
        over[inner - 1] = True
        self.ends = np.flatnonzero(over & ~space) + 1
        self.at = np.searchsorted(self.starts, texts.at)
        self.hashes = span_hashes((_LOWER_CODE if lower else _BYTE_CODE)[texts.data], self.starts, self.ends)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and where each text's begin.

        A text of fewer words has its whole sequence as its one shingle, and a
        text without words has none.
        """
        total, first, last = len(self.hashes), self.at[:-1], self.at[1:]
        end = np.repeat(last, last - first)
        place = np.arange(total)
        padded = np.concatenate((self.hashes, np.zeros(n, np.uint64)))
        sums = np.zeros(total, np.uint64)
        for k in range(n):
            sums += np.where(place + k < end, padded[k : k + total] * _SLOT[k], _SLOT[32 + k])
        counts = np.maximum(last - first - (n - 1), np.minimum(last - first, 1))
        starts = np.concatenate(([0], np.cumsum(counts)))
        keep = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(first, counts)
        return mixed(sums[keep]), starts


def distinct_by_text(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in rising order, and where each text's begin."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(sets) if sets else hashes[:0]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int64)
