"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages of ``PASSAGE`` words. A passage
is a TF-IDF vector over ``TERMS`` hashed words. A randomised SVD finds the
``RANK`` leading right singular vectors: tasks project their passages on a random
matrix and send back their part of A'(A Omega), Spark adds the parts up, and the
driver solves what is left, whose size depends on TERMS and RANK alone. In the
latent space, scaled by the singular values, every window of every document
(steps of ``STEP`` words, about as wide as the item) is compared with every item by
cosine. Candidates are checked word by word: the longest common subsequence of
the item and the window's neighbourhood must cover ``VERBATIM`` of the item, or
``PARAPHRASE`` of it and as much of its answer, the last sentence. What comes before
the answer is searched for as well, in windows of its own width, and leaks where
``VERBATIM`` of it is covered. Apart from the windows, any ``RUN`` words of an item that
follow each other in a document are a leak; all runs of all items are looked up.

Items are the queries, of any number and length. Blocks of ``BLOCK_BYTES`` of their text
bound the matrices of a task. ``GROUP_BYTES`` of them are sent to the tasks at once; a
longer benchmark is searched for group by group, and what was found is written in between.

Defined results: words are lower-cased and split at space and U+0009 to
U+000D; a null or empty text has no windows and no leaks; very long texts are searched whole; items that are null or
without words are not searched for, and those shorter than ``LEAST_WORDS`` leak where
all their words follow each other; an item without an id has a null item_id in the
leaks, after the others; repeated rows are documents of their own; of repeated items each is reported; columns other than those named are
kept, and only one named like the result is replaced; an empty table gives no rows, and
without items nothing leaks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from typeweave.llm.arrays import Texts, Words, mapped, pieces, released
from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over

TERMS, RANK, EXTRA, SEED = 1 << 13, 56, 8, 11
PASSAGE, STEP = 32, 16
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.25, 0.8, 0.6, 0.6
LEAST_WORDS, RUN = 8, 13  # items with fewer words are searched for as runs of all their words
BLOCK_BYTES, GROUP_BYTES = 256 << 10, 8 << 20
RARE = 0.05  # a word is rare if no more of the passages have its term
TASKS_A_CORE, SPLITS_A_TASK = 4, 16
WIDE = 4096  # words of an item from which on masks are made when they are asked for
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_ROWS_A_VECTOR = 16  # rows of the term matrix that travel as one vector


def _words(column: pa.Array) -> Words:
    return Words(Texts(pc.utf8_lower(column)))


def _terms(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(51)).astype(np.int32)


def _passages(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of PASSAGE words (the last of a text may be shorter), and the run of each word."""
    first, last = words.at[:-1], words.at[1:]
    counts = -(-(last - first) // PASSAGE)
    ends = np.cumsum(counts)
    starts = (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)) * PASSAGE + np.repeat(first, counts)
    return starts, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words.hashes))))


def _gathered(table: np.ndarray, words: Words, starts: np.ndarray, width: int) -> np.ndarray:
    """Sums of the table's rows over each run of ``width`` terms; the table's last row is zeros, for runs that are shorter."""
    terms = np.append(_terms(words), np.int32(len(table) - 1))
    last = np.repeat(words.at[1:], -(-np.diff(words.at) // width))
    total = np.zeros((len(starts), table.shape[1]), np.float32)
    row = np.empty_like(total)
    for k in range(width):
        at = np.where(starts + k < last, starts + k, len(terms) - 1)
        np.take(table, terms[at], axis=0, out=row)
        total += row
    return total


def _scatter(total: np.ndarray, terms: np.ndarray, rows_of: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """total[term] += rows[row] for each (term, row), where rows rise; places of one term are added in turn, those of all terms at once.

    Returns in how many rows each term is.
    """
    order = np.argsort(terms, kind="stable")
    terms, rows_of = terms[order], rows_of[order]
    other = np.append(True, terms[1:] != terms[:-1])
    starts = np.flatnonzero(other)
    counts = np.diff(np.append(starts, len(terms)))
    other[1:] |= rows_of[1:] != rows_of[:-1]
    distinct = np.bincount(terms[other], minlength=len(total))
    often = counts > 32
    for s, c in zip(starts[often].tolist(), counts[often].tolist()):
        total[terms[s]] += rows[rows_of[s : s + c]].sum(0)
    by_count = np.argsort(-counts[~often], kind="stable")
    starts, counts = starts[~often][by_count], counts[~often][by_count]
    for k in range(int(counts[0]) if len(counts) else 0):
        at = starts[: np.searchsorted(-counts, -k)] + k
        total[terms[at]] += rows[rows_of[at]]
    return distinct


@dataclass
class Space:
    """The latent vector of an occurrence of each term (and a row of zeros), and the part of passages that have the term; its size is fixed by TERMS and RANK."""

    of_term: np.ndarray
    frequency: np.ndarray


def latent_space(docs: DataFrame, items: DataFrame, text: str = "text") -> Space:
    """Fitted to all passages of both tables in one pass.

    With T the counts of terms in passages and D the weights, A is T D. Tasks
    send T'T G for a random matrix G, and how many passages have each term. So
    A'A Omega is known for Omega = G / D, with weights that needn't be known
    before the pass.
    """
    width = RANK + EXTRA
    random = np.random.default_rng(SEED).standard_normal((TERMS, width)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.vstack((random, np.zeros((1, width), np.float32)))
        total = np.zeros((TERMS, width + 2))
        image, some = np.zeros((TERMS, width)), False
        for batch in batches:
            for piece in pieces(batch, text):
                words = _words(piece.column(text))
                if not len(words.hashes):
                    continue
                some = True
                terms = _terms(words)
                starts, passage = _passages(words)
                total[0, width + 1] += len(starts)
                total[:, width] += _scatter(image, terms, passage, _gathered(padded, words, starts, PASSAGE))
        if some:
            total[:, :width] = image
            rows = total.reshape(TERMS // _ROWS_A_VECTOR, -1)
            for k in range(0, len(rows), 64):  # few rows a batch: each is a wide vector
                part = rows[k : k + 64]
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))], ["i", "row"])
        del total, image
        released()

    both = docs.select(text).unionByName(items.select(text))
    # Each task sends a matrix of fixed size, so tasks are few, but none reads more than SPLITS_A_TASK splits of a large table.
    tasks = max(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-both.rdd.getNumPartitions() // SPLITS_A_TASK))
    parts = both.coalesce(tasks).mapInArrow(run, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).select("i", vector_to_array("row").alias("row"))
    rows = {r["i"]: r["row"] for r in summed.toLocalIterator()}  # TERMS / _ROWS_A_VECTOR rows
    if not rows:
        return Space(np.zeros((TERMS + 1, RANK), np.float32), np.ones(TERMS))
    found = np.array([rows[i] for i in range(TERMS // _ROWS_A_VECTOR)]).reshape(TERMS, width + 2)
    counts, passages = found[:, width], found[0, width + 1]
    idf = np.log((passages + 1) / (counts + 1)) + 0.1
    image, omega = found[:, :width] * idf[:, None], random / idf[:, None]  # A'A Omega, Omega
    basis, _ = np.linalg.qr(image)
    # A'A restricted to the basis, from the one pass: B with B (basis' Omega) = basis' A'A Omega.
    small = np.linalg.lstsq((basis.T @ omega).T, (basis.T @ image).T, rcond=None)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:RANK]
    values = np.maximum(values[order], 1e-9 * max(values.max(), 1e-9))
    # Over the eigenvalues: leading directions, which tell little more than the language, get less weight.
    of_term = (basis @ (vectors[:, order] / values)) * idf[:, None]
    of_term /= max(float(np.abs(of_term).max()), 1e-30)
    return Space(np.vstack((of_term, np.zeros((1, RANK)))).astype(np.float32), counts / max(passages, 1))


@dataclass
class Query:
    """An item to search for, or what comes before the answer of a whole one."""

    item_id: object
    words: np.ndarray
    answer: int  # words of the last sentence
    vector: np.ndarray
    width: int  # steps of its windows
    masks: dict[int, int] = field(default_factory=dict)
    rare: np.ndarray | None = None  # its rare words
    least: int = 0  # occurrences of rare words that any leak has
    whole: Query | None = None

    def __post_init__(self) -> None:
        if len(self.words) > WIDE:
            self.order = np.argsort(self.words, kind="stable")
            self.ordered = self.words[self.order]
            return
        for k, w in enumerate(self.words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | (1 << k)

    @property
    def margin(self) -> int:
        """Words around a window that are read with it: as many as the longest item of this width has."""
        return max(len(self.words), self.width * STEP * 5 // 4)

    def mask(self, word: int) -> int:
        """The word's places in the item, as bits. Those of a wide item would fill its square, so they are made anew."""
        if len(self.words) <= WIDE:
            return self.masks.get(word, 0)
        low, high = np.searchsorted(self.ordered, np.uint64(word), "left"), np.searchsorted(self.ordered, np.uint64(word), "right")
        if low == high:
            return 0
        bits = np.zeros(len(self.words), np.uint8)
        bits[self.order[low:high]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def queries(rows: list[tuple], space: Space) -> list[Query]:
    out = []
    for item_id, text in rows:
        words = _words(pa.array([text]))
        n = len(words.hashes)
        if not n:
            continue
        last = re.split(r"(?<=[.!?])\s+", (text or "").strip())[-1]
        item = _query(item_id, words, n, min(len(last.split()), n), min(VERBATIM, PARAPHRASE), space)
        out.append(item)
        if LEAST_WORDS <= n - item.answer < n:
            question = _query(item_id, words, n - item.answer, 0, VERBATIM, space)
            question.whole = item
            out.append(question)
    return out


def _query(item_id: object, words: Words, n: int, answer: int, part: float, space: Space) -> Query:
    """Of the first n words; a leak covers at least the given part of them."""
    terms = _terms(words)[:n]
    vector = space.of_term[terms].sum(0)
    width = 2
    while n > 1.25 * width * STEP:
        width *= 2
    query = Query(item_id, words.hashes[:n], answer, vector / max(float(np.linalg.norm(vector)), 1e-30), width)
    rare = space.frequency[terms] <= RARE
    query.rare = np.unique(query.words[rare])
    # A common subsequence of so many of n places has at least this many of rare words.
    query.least = math.ceil(part * n) - int((~rare).sum())
    return query


def common(query: Query, words: list[int]) -> tuple[float, float]:
    """The parts of the item, and of its answer, in a longest common subsequence with the words; bits of one integer are the item's places."""
    n = len(query.words)
    full = (1 << n) - 1
    state, mask = full, query.masks.get if n <= WIDE else query.mask
    for w in words:
        hit = state & (mask(w) or 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    found = ~state & full
    tail = found >> (n - query.answer)
    return found.bit_count() / n, tail.bit_count() / max(query.answer, 1)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    total = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        total *= _TIMES
        total += hashes[k : k + len(total)]
    return total


class _Keys:
    """Sorted distinct hashes; a table of flags by their last bits turns most others away."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = hashes
        self.last = np.uint64((1 << max(16, int(16 * len(hashes)).bit_length())) - 1)
        self.flags = np.zeros(int(self.last) + 1, bool)
        self.flags[hashes & self.last] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the values are among the hashes, and where."""
        if not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.flatnonzero(self.flags[values & self.last])
        at = np.minimum(np.searchsorted(self.sorted, values[may]), len(self.sorted) - 1)
        hit = self.sorted[at] == values[may]
        return may[hit], at[hit]


class Search:
    """The queries of a block: their vectors by window width, the rare words that they ask for, and the items' runs by length."""

    def __init__(self, asked: list[Query]) -> None:
        self.items = [q for q in asked if q.whole is None]
        place = {id(q): k for k, q in enumerate(self.items)}
        # Items come in the order of their ids; leaks are listed by the number of different ids before, as ids may have any type.
        self.rank_of = np.cumsum([k > 0 and q.item_id != self.items[k - 1].item_id for k, q in enumerate(self.items)])
        self.asked = sorted((q for q in asked if len(q.words) >= LEAST_WORDS), key=lambda q: q.width)
        self.item_of = [place[id(q.whole or q)] for q in self.asked]
        found: dict[int, tuple[list, list]] = {}
        for k, q in enumerate(self.items):
            n = RUN if len(q.words) >= LEAST_WORDS else len(q.words)
            runs = np.unique(_runs(q.words, n))
            if len(runs):
                hashes, items = found.setdefault(n, ([], []))
                hashes.append(runs)
                items.append(np.full(len(runs), k))
        self.runs = {}
        for n, (hashes, items) in found.items():
            hashes, items = np.concatenate(hashes), np.concatenate(items)
            order = np.argsort(hashes, kind="stable")
            distinct, first = np.unique(hashes[order], return_index=True)
            self.runs[n] = _Keys(distinct), np.append(first, len(order)), items[order]
        rare = np.concatenate([np.zeros(0, np.uint64), *(q.rare for q in self.asked)])
        asks = np.repeat(np.arange(len(self.asked)), [len(q.rare) for q in self.asked])
        order = np.argsort(rare, kind="stable")
        self.asks = asks[order]  # the queries that ask for each rare word, one word's after another's
        distinct, first = np.unique(rare[order], return_index=True)
        self.rare = _Keys(distinct)
        self.asks_at = np.append(first, len(rare))
        self.least = np.array([q.least for q in self.asked])

    def rare_words(self, words: Words, block_of: np.ndarray, blocks: int) -> np.ndarray:
        """A sorted key, query * (blocks + 1) + block, for each word of a block that is one of a query's rare words."""
        hit, at = self.rare.find(words.hashes)
        first, counts = self.asks_at[at], np.diff(self.asks_at)[at]
        each = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        return np.sort(self.asks[each] * (blocks + 1) + np.repeat(block_of[hit], counts))

    def leaks(self, words: Words, space: Space) -> list[list[dict]]:
        """The leaks of each text."""
        first, last = words.at[:-1], words.at[1:]
        counts = -(-(last - first) // STEP)
        ends = np.cumsum(counts)
        text_of = np.repeat(np.arange(len(counts)), counts)
        starts = (np.arange(len(text_of)) - np.repeat(ends - counts, counts)) * STEP + np.repeat(first, counts)
        best: list[dict] = [{} for _ in counts]
        if not len(starts) or not self.items:
            return [[] for _ in counts]
        self._add_runs(best, words, space)
        window, width = _gathered(space.of_term, words, starts, STEP), 1
        block_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words.hashes))))
        rare = self.rare_words(words, block_of, len(starts))
        # A query with too few rare words among all of these words has no leak here.
        spread = np.searchsorted(rare, np.arange(len(self.asked) + 1) * (len(starts) + 1))
        may = np.diff(spread) >= self.least
        low_block, high_block = (ends - counts)[text_of], ends[text_of]
        hashes = None
        for wide in sorted({q.width for q in self.asked}):
            while width < wide:  # a window of twice the width, from two that adjoin in the same text
                wider = window.copy()
                if len(window) > width:
                    wider[:-width] += window[width:] * (text_of[width:] == text_of[:-width])[:, None]
                window, width = wider, 2 * width
            own = np.array([k for k, q in enumerate(self.asked) if q.width == wide and may[k]], np.int64)  # rise
            if not len(own):
                continue
            matrix = np.array([self.asked[k].vector for k in own], np.float32)
            margins = np.array([self.asked[k].margin for k in own])
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-30)
            cosine = (matrix @ window.T) / norm
            which, at = np.nonzero(cosine >= COSINE)  # by query, so that keys rise
            # Candidates whose neighbourhood, in whole blocks, lacks the rare words can't pass the check.
            around, q = -(-margins[which] // STEP), own[which]
            low, high = np.maximum(at - around, low_block[at]), np.minimum(at + wide + around, high_block[at])
            key = q * (len(starts) + 1)
            enough = np.searchsorted(rare, key + high) - np.searchsorted(rare, key + low) >= self.least[q]
            at, which = at[enough], which[enough]
            if len(at) and hashes is None:
                hashes = words.hashes.tolist()
            for i, q in zip(at.tolist(), which.tolist()):
                query, text = self.asked[own[q]], int(text_of[i])
                margin = query.margin
                begin, stop = max(int(first[text]), int(starts[i]) - margin), min(int(last[text]), int(starts[i]) + wide * STEP + margin)
                share, answer = common(query, hashes[begin:stop])
                if share >= VERBATIM or (query.whole is None and share >= PARAPHRASE and answer >= ANSWER):
                    if query.whole is not None:
                        share, answer = common(query.whole, hashes[begin:stop])
                    _keep(best[text], self.item_of[own[q]], query.item_id, int(starts[i] - first[text]), float(cosine[q, i]), share, answer)
        return [[b[k] for k in sorted(b, key=lambda k: (b[k]["item_id"] is None, self.rank_of[k], b[k]["word"]))] for b in best]

    def _add_runs(self, best: list[dict], words: Words, space: Space) -> None:
        """Adds the leaks by runs: all words of a short item, RUN words of any other."""
        terms = None
        for n, (keys, ends, items) in self.runs.items():
            hit, at = keys.find(_runs(words.hashes, n))
            text_of = np.searchsorted(words.at, hit, "right") - 1
            inside = hit + n <= words.at[text_of + 1]
            hit, text_of, low, high = hit[inside], text_of[inside], ends[at[inside]], ends[at[inside] + 1]
            beyond: dict[tuple[int, int], int] = {}  # a run is read with its neighbourhood, so the next few needn't be
            for at, text, some, stop in zip(hit.tolist(), text_of.tolist(), low.tolist(), high.tolist()):
                for k in items[some:stop].tolist():
                    query, long = self.items[k], len(self.items[k].words)
                    if at < beyond.get((text, k), 0):
                        continue
                    beyond[text, k] = at + long if n == RUN else int(words.at[text + 1])
                    terms = _terms(words) if terms is None else terms
                    begin, end = max(int(words.at[text]), at - long), min(int(words.at[text + 1]), at + 2 * long)
                    vector = space.of_term[terms[at : min(at + long, end)]].sum(0)
                    cosine = float(vector @ query.vector) / max(float(np.linalg.norm(vector)), 1e-30)
                    _keep(best[text], k, query.item_id, int(at - words.at[text]), cosine, *common(query, words.hashes[begin:end].tolist()))


def _keep(best: dict, k: int, item_id: object, word: int, cosine: float, share: float, answer: float) -> None:
    """The best leak of each item."""
    old = best.get(k)
    if old is None or (share, cosine) > (old["common"], old["cosine"]):
        best[k] = {"item_id": item_id, "word": word, "cosine": cosine, "common": share, "answer": answer}


def _groups(items: DataFrame, item_id: str, text: str) -> Iterator[list[list[tuple]]]:
    """Blocks of items, in groups that are sent to the tasks at once."""
    group, block, in_group, in_block = [], [], 0, 0
    for row in items.select(item_id, text).where(F.col(text).isNotNull()).orderBy(item_id, text).toLocalIterator():
        block.append((row[0], row[1]))
        size = len(row[1].encode())
        in_group, in_block = in_group + size, in_block + size
        if in_block > BLOCK_BYTES or in_group > GROUP_BYTES:
            group.append(block)
            block, in_block = [], 0
        if in_group > GROUP_BYTES:
            yield group
            group, in_group = [], 0
    if block or group:
        yield [*group, block] if block else group


def with_leaks(docs: DataFrame, items: DataFrame, space: Space | None = None, text: str = "text", item_id: str = "item_id", keep_text: bool = True, out: str = "leaks") -> DataFrame:
    """Adds the array of items that leak into each document: item_id, word, cosine, common, answer.

    ``items`` has item_id, of any type that Spark can order, and a column named like ``text``. word is the
    place of the window's first word, common and answer are the parts of the
    item and of its last sentence that the window's neighbourhood shares in order.
    """
    space = space or latent_space(docs, items, text)
    send = docs.sparkSession.sparkContext.broadcast
    shared = send(space)
    id_type = items.schema[item_id].dataType
    kind = f"array<struct<item_id: {id_type.simpleString()}, word: long, cosine: double, common: double, answer: double>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("word", pa.int64()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.float64())]))
    found, parts = docs, []
    for group in _groups(items, item_id, text):
        asked = send([Search(queries(block, space)) for block in group])
        name, = unused([*found.columns, out], "leaks")

        def make(asked=asked, name=name):
            def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
                words = _words(batch.column(text))
                each = [search.leaks(words, shared.value) for search in asked.value]
                return {name: pa.array([[leak for leaks in of_text for leak in leaks] for of_text in zip(*each)], arrow)}

            return run

        found = mapped(handed_over(found, "leaks") if parts else found, make, f"`{name}` {kind}", text)
        parts.append(name)
    new, = unused([*found.columns, out], "all_leaks")
    leaks = F.flatten(F.array(*parts)) if parts else F.array().cast(kind)
    done = found.withColumn(new, leaks).drop(*parts, out).withColumnRenamed(new, out)
    return done if keep_text else done.drop(text)
