"""A store of long sequences in chunks, and ranges looked up in it.

A sequence of any length is cut into chunks of ``CHUNK`` code points, keyed by its name and the
chunk's number. A range asks for the chunks that it touches alone and is stitched from
their parts, so that neither a long sequence nor one that many ranges ask for is held by
one task, and what is read doesn't grow with the sequence's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.sources.tables import handed_over

CHUNK = 16_384
TOGETHER = 64  # chunks handed on at once


def store(contigs: DataFrame, name: str, seq: str) -> DataFrame:
    """(contig, chunk, piece) of all sequences; a null or empty one has no chunks. Names are unique."""
    rows = contigs.select(F.col(name).alias("contig"), F.col(seq).alias("seq")).where("seq <> ''")
    kind = rows.schema["contig"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, text in zip(batch.column("contig"), batch.column("seq")):
                whole = text.as_py()
                for start in range(0, len(whole), CHUNK * TOGETHER):
                    pieces = [whole[a : a + CHUNK] for a in range(start, min(start + CHUNK * TOGETHER, len(whole)), CHUNK)]
                    numbers = pa.array(range(start // CHUNK, start // CHUNK + len(pieces)), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([contig.as_py()] * len(pieces), batch.column("contig").type), numbers, pa.array(pieces, pa.string())], ["contig", "chunk", "piece"])

    return handed_over(rows.mapInArrow(run, f"contig {kind}, chunk bigint, piece string"), "sequence-store")


def ranges(found: DataFrame, hits: DataFrame, contig: str, start: str, end: str, out: str = "part") -> DataFrame:
    """``hits`` with ``out``: code points start to end of its contig, 1-based and inclusive; where start is beyond
    end they are read backwards and complemented. What lies outside of the contig is left out, and a hit that
    touches nothing of one in the store, or has a null bound, has null.

    Hits are first held against the contigs' lengths, so that those that touch nothing go no further. A hit within one chunk is cut
    where it meets it; only the parts of hits that cross chunks are dealt out again. ``hits`` is read twice.
    """
    lengths = handed_over(found.groupBy(F.col("contig").alias("_contig")).agg(F.max(F.col("chunk") * CHUNK + F.length("piece")).alias("_length")), "sequence-lengths")
    low = F.greatest(F.least(start, end).cast("bigint"), F.lit(1).cast("bigint")) - 1
    high = F.least(F.greatest(start, end).cast("bigint"), F.col("_length")) - 1
    bounded = hits.join(lengths, F.col(contig) == F.col("_contig"), "left").withColumns({"_low": low, "_high": high})
    touches = F.col("_contig").isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col("_low") <= F.col("_high"))
    first, last = F.expr(f"_low div {CHUNK}"), F.expr(f"_high div {CHUNK}")
    asked = handed_over(bounded.where(touches).drop("_length"), "sequence-hits")
    pieces = found.select(F.col("contig").alias("_contig"), F.col("chunk").alias("_chunk"), F.col("piece").alias("_piece"))
    base = F.col("_chunk") * CHUNK
    begin, stop = F.greatest(F.col("_low") - base, F.lit(0)), F.least(F.col("_high") - base, F.lit(CHUNK - 1))
    cut = F.substring("_piece", (begin + 1).cast("int"), (stop - begin + 1).cast("int"))
    one = asked.where(first == last).withColumn("_chunk", first).join(pieces, ["_contig", "_chunk"]).select(*hits.columns, cut.alias("_s"))
    crossing = handed_over(asked.where(first != last).withColumn("_hit", F.monotonically_increasing_id()), "sequence-crossing")
    parts = crossing.select("_hit", "_contig", "_low", "_high", F.explode(F.sequence(first, last)).alias("_chunk")).join(pieces, ["_contig", "_chunk"]).select("_hit", "_chunk", cut.alias("s"))
    whole = parts.groupBy("_hit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "s"))), lambda x: x["s"]), "").alias("_s"))
    many = crossing.join(whole, "_hit").select(*hits.columns, "_s")
    none = bounded.where(~F.coalesce(touches, F.lit(False))).select(*hits.columns, F.lit(None).cast("string").alias("_s"))
    back = F.translate(F.reverse("_s"), "ACGTacgt", "TGCAtgca")
    return one.unionByName(many).unionByName(none).select(*hits.columns, F.when(F.col(start) <= F.col(end), F.col("_s")).otherwise(back).alias(out))
