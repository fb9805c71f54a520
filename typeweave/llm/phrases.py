"""Phrase collocation mining by set-oriented relations (SETM).

Texts are cut into pieces, and pieces into words. An occurrence relation has a row
for each chunk of one language's pieces; its places rise, with a step of one from
word to word and of two across the end of a piece, so that neighbours stand in one
piece. Relation k holds the occurrences of all frequent phrases of k words; it is
written, read back, and merge-joined with itself at adjacent places: occurrences of
frequent k-word phrases at p and p + 1 are one of a phrase of k + 1 words, named by
the two ids. These are group-counted in the tasks, then by Spark, and the frequent
ones are semi-joined before the next length. Counts are exact integers throughout,
over whole texts: names are ids or words, never hashes.

A semi-join sends the frequent groups to the tasks where they are at most
``MOST_SENT``; beyond that the occurrences are dealt out and joined by group, and
sorted back into chunks as they stream by.

What a task holds doesn't grow with the table: a chunk's places and ids are packed
integers in one binary value each (arrays are taken apart by element, with levels
beside each, wherever Spark reads or writes them), chunks have a bounded number of
words, and the relations' row groups, which Spark reads whole, of bytes.

Defined results: a null text is an empty one and has no words; a null language is
``und``; repeated rows count each time; a text of any length is handled whole (its
pieces are dealt over chunks of about ``CHUNK_WORDS`` words, and only one longer
piece makes a larger chunk); other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typeweave.llm.arrays import Texts, bounded, released
from typeweave.operators.offsets import ranked
from typeweave.sources.tables import discarded, handed_over

LEAST, LONGEST, SCALE = 100, 5, 1000
CHUNK_WORDS = 1 << 17
ROW_GROUP_BYTES = 4 << 20
MOST_SENT = 2_000_000  # frequent groups that may be sent to the tasks, of 16 bytes or a word each
BUCKET_ROWS = 1 << 16
UNKNOWN = "und"
#: Bytes that end a piece, and those that part words within one.
_PIECE_END, _SPACE = b".,;:!?\n\x0b\x0c\r", b" \t"

_MAPPED = np.arange(256, dtype=np.uint8)
_MAPPED[65:91] += 32
_MAPPED[list(_PIECE_END)] = 10
_MAPPED[list(_SPACE)] = 32


def _words(texts: Texts) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words, their places (adjoining within a piece alone), and the first word of each text."""
    data = _MAPPED[texts.data]
    ends, apart = data == 10, data <= 32
    apart &= ends | (data == 32)
    first = np.zeros(len(data), bool)
    first[texts.at[:-1][texts.at[:-1] < len(data)]] = True  # texts part pieces too
    before = np.ones(len(data), bool)
    before[1:] = apart[:-1]
    starts = np.flatnonzero(~apart & (before | first))
    at = np.searchsorted(starts, texts.at)
    breaks = np.cumsum(ends | first)
    piece = breaks[starts]
    places = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(np.diff(piece) > 0))) if len(starts) else np.zeros(0, np.int64)
    kept = np.concatenate(([0], np.cumsum(~apart)))
    offsets = np.append(kept[starts], kept[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~apart])])
    return words, places, at


def _cuts(places: np.ndarray, size: int) -> list[int]:
    """Where chunks begin and end: at piece ends, after about ``size`` words."""
    cuts = [0]
    ends = np.flatnonzero(np.diff(places) > 1) + 1
    while (k := int(np.searchsorted(ends, cuts[-1] + size))) < len(ends):
        cuts.append(int(ends[k]))
    return [*cuts, len(places)]


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold the largest; the first byte tells how many."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpacked(value: pa.BinaryScalar) -> np.ndarray:
    data = value.as_buffer()
    return np.frombuffer(data, f"u{memoryview(data)[0]}", offset=1).astype(np.int64)


def relation(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(chunk, lang, words, times, steps, at): distinct words of a chunk with their counts, and (packed) the word at each rising place."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.dictionary_encode(batch.column("lang"))
            for k, name in enumerate(langs.dictionary.to_pylist()):
                words, places, _ = _words(Texts(batch.column("text").filter(pc.equal(langs.indices, k))))
                for a, b in zip((cuts := _cuts(places, CHUNK_WORDS))[:-1], cuts[1:]):
                    if a < b:
                        coded = words.slice(a, b - a).dictionary_encode()
                        ids = coded.indices.to_numpy()
                        found, times = coded.dictionary.cast(pa.binary()).cast(pa.string()), pa.array(np.bincount(ids), pa.int64())
                        whole = pa.array([0, len(found)], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name], pa.string()), pa.ListArray.from_arrays(whole, found), pa.ListArray.from_arrays(whole, times),
                             pa.array([_packed(np.diff(places[a:b], prepend=places[a]))], pa.binary()), pa.array([_packed(ids)], pa.binary())],
                            ["lang", "words", "times", "steps", "at"],
                        )
        released()

    chunks = bounded(rows).mapInArrow(run, "lang string, words array<string>, times array<bigint>, steps binary, at binary")
    return handed_over(chunks.withColumn("chunk", F.monotonically_increasing_id()), "phrase-words", row_group=ROW_GROUP_BYTES)


def _numbered(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``id`` from 0, in buckets of a bounded number of rows."""
    groups = handed_over(groups, "phrase-groups")
    buckets = -(-groups.count() // BUCKET_ROWS) or 1
    return handed_over(ranked(groups.withColumn("_all", F.lit(0)), ["_all"], F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("bigint")), keys, "id").drop("_all"), "phrase-groups")


def _related(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of a relation from (chunk, rising places, ids)."""
    for chunk, places, ids in rows:
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_packed(np.diff(places, prepend=0))], pa.binary()), pa.array([_packed(ids)], pa.binary())], ["chunk", "steps", "ids"])
    released()


RELATION = "chunk bigint, steps binary, ids binary"


def _gathered(rows: DataFrame) -> DataFrame:
    """The relation of rows (chunk, place, id) in any order: sorted by Spark, which spills, and packed as they stream by."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        last, held = None, []
        for batch in batches:
            chunk, place, ids = (batch.column(c).to_numpy() for c in ("chunk", "place", "id"))
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a < b:
                    if held and chunk[a] != last:
                        yield last, *map(np.concatenate, zip(*held))
                        held = []
                    last = int(chunk[a])
                    held.append((place[a:b], ids[a:b]))
        if held:
            yield last, *map(np.concatenate, zip(*held))

    dealt = rows.repartition("chunk").sortWithinPartitions("chunk", "place")
    return handed_over(bounded(dealt).mapInArrow(lambda batches: _related(runs(batches)), RELATION), "phrase-relation", row_group=ROW_GROUP_BYTES)


def _placed(batch: pa.RecordBatch, known: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each chunk's places of frequent words, and their ids; known: the id of each of its words, or -1."""
    for chunk, steps, at, ids in zip(batch.column("chunk").to_pylist(), batch.column("steps"), batch.column("at"), known):
        each = ids[_unpacked(at)]
        yield chunk, np.cumsum(_unpacked(steps))[each >= 0], each[each >= 0]


def _first(chunks: DataFrame, frequent: DataFrame) -> DataFrame:
    """Relation 1 (chunk, steps, ids): the occurrences of frequent words; steps are those between places."""
    spark = chunks.sparkSession
    if frequent.count() <= MOST_SENT:
        table = frequent.select("lang", "word", "id").toArrow()  # at most MOST_SENT words
        of_lang = {k: (sub := table.filter(pc.equal(table["lang"], k)))["word"].combine_chunks() for k in pc.unique(table["lang"]).to_pylist()}
        ids_of = {k: table.filter(pc.equal(table["lang"], k))["id"].to_numpy() for k in of_lang}
        sent = spark.sparkContext.broadcast((of_lang, ids_of))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            of_lang, ids_of = sent.value
            for batch in batches:
                langs = batch.column("lang").to_pylist()
                for name in dict.fromkeys(langs):
                    if name in of_lang:  # one look-up for all its chunks, as each hashes the frequent words anew
                        part = batch.take([k for k, x in enumerate(langs) if x == name])
                        words = part.column("words")
                        where = pc.index_in(words.flatten(), value_set=of_lang[name]).fill_null(-1).to_numpy(zero_copy_only=False)
                        ids = np.append(ids_of[name], -1)[where]
                        yield from _placed(part, iter(np.split(ids, np.cumsum(words.value_lengths().to_numpy())[:-1])))

        held = bounded(chunks.select("chunk", "lang", "words", "steps", "at")).mapInArrow(lambda batches: _related(looked_up(batches)), RELATION)
        return handed_over(held, "phrase-relation", row_group=ROW_GROUP_BYTES)
    local = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    hits = handed_over(local.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select("chunk", F.col("place").cast("bigint"), "id"), "phrase-hits")

    def spread(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for size, places, ids in zip(batch.column("size").to_pylist(), batch.column("places"), batch.column("ids")):
            known = np.full(size, -1)
            known[np.cumsum(_unpacked(places))] = _unpacked(ids)
            yield known

    gathered = _gathered(hits)
    discarded(hits)
    known = chunks.select("chunk", F.size("words").alias("size"), "steps", "at").join(gathered.withColumnRenamed("steps", "places"), "chunk")
    held = bounded(known).mapInArrow(lambda batches: _related(x for batch in batches for x in _placed(batch, spread(batch))), RELATION)
    held = handed_over(held, "phrase-relation", row_group=ROW_GROUP_BYTES)
    discarded(gathered)
    return held


def _joined(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each chunk: places p with an occurrence at p and one at p + 1, and the key of the two ids."""
    for chunk, steps, ids in zip(batch.column("chunk").to_pylist(), batch.column("steps"), batch.column("ids")):
        places, ids = np.cumsum(_unpacked(steps)), _unpacked(ids)
        meet = np.flatnonzero(np.diff(places) == 1)  # both sides are sorted and of one relation, so the merge is one step ahead
        yield chunk, places[meet], ids[meet] * width + ids[meet + 1]


def _counted(held: DataFrame, width: int) -> DataFrame:
    """(key, a) of the phrases that are one word longer, over all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(keys for _, _, keys in _joined(batch, width))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])
        released()

    return bounded(held).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("a"))


def _longer(held: DataFrame, frequent: DataFrame, width: int) -> DataFrame:
    """The relation of the next length: the merge-join, semi-joined with the frequent keys."""
    if frequent.count() <= MOST_SENT:
        table = frequent.select("key", "id").toArrow()  # at most MOST_SENT pairs of integers
        order = np.argsort(keys := table["key"].to_numpy())
        sent = held.sparkSession.sparkContext.broadcast((keys[order], table["id"].to_numpy()[order]))

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            known, numbers = sent.value
            for batch in batches:
                for chunk, places, keys in _joined(batch, width):
                    where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[where] == keys
                    if hit.sum() > 1:
                        yield chunk, places[hit], numbers[where[hit]]

        made = bounded(held).mapInArrow(lambda batches: _related(looked_up(batches)), RELATION)
        return handed_over(made, "phrase-relation", row_group=ROW_GROUP_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, places, keys in _joined(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(places), pa.array(keys)], ["chunk", "place", "key"])
        released()

    rows = handed_over(bounded(held).mapInArrow(run, "chunk bigint, place bigint, key bigint"), "phrase-rows")
    found = _gathered(rows.join(frequent.select("key", "id"), "key").select("chunk", "place", "id"))
    discarded(rows)
    return found


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all frequent phrases of 1 to ``longest`` words, and each language's word count n.

    phrases has k, id, lang, phrase, a, ``first`` and ``rest``: the counts of its first and last 1 to k
    words, and ``left`` and ``right``, the ids of its first and last k - 1 words.
    """
    chunks = relation(docs, text, lang)
    words = chunks.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.times").alias("a"))
    words = handed_over(words, "phrase-counts")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = _numbered(words.where(F.col("a") >= least), ["lang", "word"])
    counts = F.array("a")
    known = frequent.select(F.lit(1).alias("k"), "id", "lang", F.col("word").alias("phrase"), "a", counts.alias("first"), counts.alias("rest"), F.lit(None).cast("bigint").alias("left"), F.lit(None).cast("bigint").alias("right"))
    levels, held = [known], _first(chunks, frequent)
    discarded(chunks)  # what the next relation replaces isn't read again
    for k in range(2, longest + 1):
        width = levels[-1].count()
        if width == 0:
            break
        if width > 3_000_000_000:
            raise OverflowError("a pair of ids exceeds 64 bits")
        frequent = _numbered(_counted(held, width).where(F.col("a") >= least), ["key"])
        if frequent.isEmpty():
            break
        if k < longest:
            longer = _longer(held, frequent, width)
            discarded(held)
            held = longer
        sides = frequent.select("id", "key", "a", F.expr(f"key div {width}").alias("left"), F.expr(f"key % {width}").alias("right"))
        side = lambda name, *cols: levels[-1].select(F.col("id").alias(name), *cols)
        both = sides.join(side("left", "lang", F.col("phrase").alias("_head"), "first"), "left").join(side("right", F.col("phrase").alias("_tail"), "rest"), "right")
        levels.append(handed_over(both.select(
            F.lit(k).alias("k"), "id", "lang", F.concat_ws(" ", "_head", F.substring_index("_tail", " ", -1)).alias("phrase"), "a",
            F.concat("first", F.array("a")).alias("first"), F.concat("rest", F.array("a")).alias("rest"), "left", "right",
        ), "phrase-level"))
    discarded(held)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def _score(a: Column, n: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale * a * n / (left * right)) by decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(a * F.lit(scale)) * wide(n)).cast("decimal(38,0)")
    return F.call_function("div", top, (wide(left) * wide(right)).cast("decimal(38,0)")).cast("bigint")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by their weakest cut.

    A phrase that occurs only within a longer frequent one is left out. It is enough to look one
    word further: counts between a phrase and a longer one that has as many are all the same.
    """
    phrases, totals = mined(docs, text, lang, least, longest)
    phrases = handed_over(phrases, "phrases")
    inner = phrases.where("k > 2").select((F.col("k") - 1).alias("k"), F.explode(F.array(
        F.struct(F.col("left").alias("id"), F.element_at("first", -2).alias("of")), F.struct(F.col("right").alias("id"), F.element_at("rest", -2).alias("of")))).alias("s"), "a")
    inner = inner.where(F.col("s.of") <= F.col("a")).select("k", "s.id").distinct()
    rows = phrases.where("k > 1").join(inner, ["k", "id"], "left_anti").join(totals, "lang")
    cut = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(
        _score(F.col("a"), F.col("n"), F.element_at("first", j), F.element_at("rest", F.col("k") - j), SCALE).alias("score"), j.alias("j"),
        F.element_at("first", j).alias("l"), F.element_at("rest", F.col("k") - j).alias("r")))
    scored = rows.withColumn("c", F.array_min(cut)).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    # Spark keeps each task's first rows of a language before they are dealt out.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
