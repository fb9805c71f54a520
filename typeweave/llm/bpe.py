"""Byte-pair encoding and decoding.

A text is cut at special tokens and then into words by the byte-level pattern.
A word's bytes are a doubly linked list of symbols. A priority queue holds the
merges that its neighbours allow, by rank and then place; an entry whose symbols
have changed since is stale and skipped. Decoding concatenates the vocabulary's
strings and turns their characters back into bytes.

Texts are cut in batches, and only a batch's distinct words that aren't known yet are encoded, their queues side by side in arrays.
Each worker process keeps encoded words, which its later tasks find too: two generations of ``CACHED_WORDS`` words (and one batch's)
and none longer than ``CACHED_CHARS``, which are encoded one by one, as texts repeat most of theirs. The vocabulary is read from the tokenizer's JSON on the driver and sent
to the executors; its size is checked, as it must not grow with the data.

Defined results: a null text is an empty one and has no ids; very long texts and words
are encoded whole; a null list of ids decodes to null; ids that the vocabulary lacks,
negative ones and nulls among ids raise an error; repeated rows are encoded one
by one; a column with the name of the result is replaced; an empty table gives
no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from typeweave.llm.arrays import bounded, mapped

MOST_IDS = 1 << 20
#: The byte-level pattern of public tokenizers, with white space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for texts of ASCII alone.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
CACHED_WORDS, CACHED_CHARS = 200_000, 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Codec:
    """Merges by pair, and the bytes of each id, from a tokenizer's JSON."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text("utf-8"))
        kind, vocab = spec["model"]["type"], spec["model"]["vocab"]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if kind != "BPE" or not plain or odd or max(len(vocab), max(vocab.values())) + len(added) > MOST_IDS:
            raise ValueError(f"{path} isn't a byte-level BPE tokenizer of at most {MOST_IDS} ids")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.special = added
        self.bytes_of: list[bytes | None] = [None] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.first = [vocab[c] for c in byte_characters()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if len(pairs) > MOST_IDS:
            raise ValueError(f"{path} has more than {MOST_IDS} merges")
        self.known: _Known | None = None
        self.merges = {(vocab[a] << 32) | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.byte_ranks = [self.merges.get(a << 32 | b, -1) for a in self.first for b in self.first]
        pairs_at = sorted(self.merges)
        self.pairs = np.array([*pairs_at, 1 << 62])
        self.pair_ranks = np.array([*(self.merges[p] for p in pairs_at), -1])
        self.vocabulary_bytes = np.frombuffer(b"".join(t or b"" for t in self.bytes_of), np.uint8)
        self.bytes_at = np.concatenate(([0], np.cumsum([len(t or b"") for t in self.bytes_of])))

    def word(self, text: str) -> tuple[int, ...]:
        """The ids of one word."""
        data = text.encode()
        n = len(data)
        first = self.first
        if n == 1:
            return (first[data[0]],)
        symbols = [first[b] for b in data]
        rank_of, merged = self.merges.get, self.merged
        # The rank of each symbol with the one after it, -1 for none: an entry of the queue that says otherwise is stale.
        ranks = [self.byte_ranks[a << 8 | b] for a, b in zip(data, data[1:])]
        queue = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not queue:
            return tuple(symbols)
        ranks.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            top = pop(queue)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if ranks[i] != rank:
                continue  # stale
            j = after[i]
            symbol = symbols[i] = merged[rank]
            symbols[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                ranks[i] = rank = rank_of(symbol << 32 | symbols[k], -1)
                if rank >= 0:
                    push(queue, rank << 32 | i)
            else:
                ranks[i] = -1
            k = before[i]
            if k >= 0:
                ranks[k] = rank = rank_of(symbols[k] << 32 | symbol, -1)
                if rank >= 0:
                    push(queue, rank << 32 | k)
        return tuple([s for s in symbols if s >= 0])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols, -1 for none."""
        wanted = left << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], -1)

    def queued(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``word`` for many words of at most CACHED_CHARS characters at once: their ids, and where each word's begin.

        The words' lists and queues lie side by side. Entries are ordered by word,
        rank and place, and each round takes the first of every word that isn't stale.
        Behind each word stands a symbol that no merge has.
        """
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"\0".join([*data, b""]), np.uint8)
        symbols = np.array(self.first)[raw]
        none = len(self.bytes_of)
        symbols[ends - 1] = none
        word_of = np.repeat(np.arange(len(data)), sizes)
        start = (ends - sizes)[word_of]
        merged, n = np.array(self.merged, np.int64), len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the first word has the last one's end before it
        ranks = np.full(n, -1)
        ranks[:-1] = self.ranks_of(symbols[:-1], symbols[1:])
        at = np.flatnonzero(ranks >= 0)
        # A place is below 2**9, as a character has four bytes at most, and a rank below MOST_IDS.
        queue = np.sort(word_of[at] << 29 | ranks[at] << 9 | (at - start[at]))
        first_of = ends - sizes
        while len(queue):
            word = queue >> 29
            place = first_of[word] + (queue & 511)
            live = ranks[place] == (queue >> 9 & (MOST_IDS - 1))
            queue, word, place = queue[live], word[live], place[live]  # the others are stale
            if not len(queue):
                break
            top = np.append(True, word[1:] != word[:-1])
            i, queue = place[top], queue[~top]
            j = after[i]
            symbols[i] = symbol = merged[ranks[i]]
            symbols[j] = ranks[j] = -1
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            ranks[i] = right = self.ranks_of(symbol, symbols[k])
            ranks[h] = left = self.ranks_of(symbols[h], symbol)
            at, rank = np.concatenate((i, h)), np.concatenate((right, left))
            some = rank >= 0
            at, rank = at[some], rank[some]
            pushed = word_of[at] << 29 | rank << 9 | (at - start[at])
            queue = np.sort(np.concatenate((queue, pushed)))
        kept = (symbols >= 0) & (symbols != none)
        return symbols[kept].astype(np.int32), np.concatenate(([0], np.cumsum(kept)[ends - 1]))

    def batch_encoder(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        """A function for lists of texts: all their ids, and where each text's begin. The codec keeps words for later tasks of its process too."""
        words, plain_words = regex.compile(PATTERN).findall, re.compile(PLAIN_PATTERN).findall
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if self.known is None:
            self.known = _Known(self)

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found: list[str] = []
            at = [0]
            for text in texts:
                find = plain_words if text.isascii() else words
                if not (cut and any(s in text for s in self.special)):
                    found += find(text)
                else:
                    for k, part in enumerate(cut.split(text)):
                        found += [part] if k % 2 else find(part)
                at.append(len(found))
            ids, ends = self.known.of(found)
            return ids, ends[at]

        return encode

    def encoder(self) -> Callable[[str], list[int]]:
        """The same for one text."""
        encode = self.batch_encoder()
        return lambda text: encode([text])[0].tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        known = np.asarray(ids)
        return self.decoded_bytes(known, np.array([0, len(known)]))[0].tobytes().decode("utf-8", "replace")

    def decoded_bytes(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of lists of ids, the k-th from at[k] to at[k + 1], and where each list's begin."""
        if len(ids) and (ids.dtype.kind not in "iu" or ids.min() < 0 or ids.max() >= len(self.bytes_of)):
            raise ValueError(f"not ids of the vocabulary, which has {len(self.bytes_of)}")
        data, ends = _gather(self.vocabulary_bytes, self.bytes_at, ids.astype(np.int64))
        return data, ends[at]


class _Known:
    """Ids of words met: a word's number in ``number``, its ids from ``at[number]`` on in ``ids``.

    A batch's missing words are looked up among the last generation's, ``old``, before they are
    made; once CACHED_WORDS are held, the words become the old generation.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.old = codec, None
        self.fresh()

    def fresh(self) -> None:
        special = self.codec.special
        self.number = {token: k for k, token in enumerate(special)}  # no word holds one of these
        self.ids = np.array([*special.values()], np.int32)
        self.at = np.arange(len(special) + 1)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word's after another's, and where each word's begin."""
        if len(self.number) >= CACHED_WORDS:
            self.old = (self.number, self.ids, self.at)
            self.fresh()
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        asked = [words[k] for k in unknown.tolist()]
        missing = [*dict.fromkeys(asked)]
        long = [w for w in missing if len(w) > CACHED_CHARS]
        if long:
            missing = [w for w in missing if len(w) <= CACHED_CHARS]
        if self.old and missing:
            number, ids, at = self.old
            met = [w for w in missing if w in number]
            self.add(met, *_gather(ids, at, np.fromiter(map(number.__getitem__, met), np.int64, len(met))))
            missing = [w for w in missing if w not in number]
        if missing:
            self.add(missing, *self.codec.queued(missing))
        held = (self.ids, self.at)
        for w in long:  # these are forgotten after the batch
            made = np.array(self.codec.word(w), np.int32)
            self.add([w], made, np.array([0, len(made)]))
        numbers[unknown] = np.fromiter(map(self.number.__getitem__, asked), np.int64, len(asked))
        found = _gather(self.ids, self.at, numbers)
        for w in long:
            del self.number[w]
        self.ids, self.at = held
        return found

    def add(self, words: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.at) - 1, len(self.at) - 1 + len(words))))
        self.at = np.concatenate((self.at, at[1:] + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))


def _gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values from at[row] to at[row + 1] of each row, and where each row's begin."""
    first = at[rows]
    ends = np.concatenate(([0], np.cumsum(at[rows + 1] - first)))
    return values[np.arange(ends[-1]) + np.repeat(first - ends[:-1], np.diff(ends))], ends


def shared(df: DataFrame, path: str) -> Broadcast:
    """The codec, sent to the executors; MOST_IDS bounds its size."""
    return df.sparkSession.sparkContext.broadcast(Codec(path))


def encoded(df: DataFrame, text: str, codec: Broadcast, out: str = "token_ids", keep_text: bool = True) -> DataFrame:
    """Adds the array of ids of each text."""

    def make():
        encode = codec.value.batch_encoder()

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            ids, at = encode([t or "" for t in batch.column(text).to_pylist()])
            return {out: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))}

        return run

    return mapped(df, make, f"`{out}` array<int>", text, drop=() if keep_text else (text,))


def decoded(df: DataFrame, ids: str, codec: Broadcast, out: str) -> DataFrame:
    """Adds the text that each array of ids stands for."""
    from pyspark.sql import functions as F

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        given = np.asarray(column.is_valid())
        lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("a null isn't an id of the vocabulary")
        data, at = codec.value.decoded_bytes(flat.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths))))
        buffer = data.tobytes()
        texts = [buffer[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.array(texts, pa.string(), mask=~given)

    return bounded(df).withColumn(out, run(ids))
