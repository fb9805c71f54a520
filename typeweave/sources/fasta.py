"""Sequence files as tables: one row a record, in three readings.

A record is what stands between two lines that begin with ``>``. Its first line is the header;
the others, without white space at their ends, are joined and upper-cased. Records without a body
are left out. Text before a file's first header is a record without a header: all of it is sequence to those who
count bases, and readings by header leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.operators.seq import ascii_upper, trimmed
from typeweave.sources.tables import handed_over


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.url_decode(F.substring_index(path, "/", -1)), r"(?<=.)\.[^.]*$", "")


def records(spark: SparkSession, folder: str, pattern: str = "*.fasta") -> DataFrame:
    """(stem, header, seq, path, place) of all records in the folder's files and those below that match the pattern.

    place orders the records of a file. Files are split, and no file is held as a whole.
    """
    read = spark.read.option("lineSep", "\n>").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder)
    path = F.col("_metadata.file_path")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    found = read.select("value", path.alias("path"), place.alias("place"))
    # Separators take the > of all records but a file's first.
    firsts = found.select("path", "place", F.col("value").startswith(">").alias("headed")).groupBy("path").agg(F.min("place").alias("place"), F.min_by("headed", "place").alias("headed"))
    # Written, so that the join knows that it is a row a file at most, and no sequence is dealt out for it.
    odd = handed_over(firsts.where("NOT headed").select("path", "place", F.lit(True).alias("headless")), "headless")
    lines = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    header = F.when(F.col("headless"), "").otherwise(trimmed(F.get(lines, 0)))
    text = F.when(F.col("headless"), F.col("value")).otherwise(F.coalesce(F.get(lines, 1), F.lit("")))
    whole = found.join(odd, ["path", "place"], "left").select("path", "place", header.alias("header"), text.alias("text")).where(F.col("text").rlike(r"\S"))
    # Most bodies are one line, which needs no pattern but at its ends.
    joined = F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", r"\s*\n\s*", "")).otherwise(F.col("text"))
    ends = F.concat(F.substring(joined, 1, 1), F.substring(joined, -1, 1))
    body = F.when(ends.rlike(r"[\s\x85\u2028\u2029]"), trimmed(joined)).otherwise(joined)  # the last three may stand behind white space at an end
    return whole.select(stem(F.col("path")).alias("stem"), "header", ascii_upper(body).alias("seq"), "path", "place")


def by_header(found: DataFrame) -> DataFrame:
    """(stem, id, seq): records by their whole header; the last of those that share one wins, and an empty header is none."""
    return found.where("header <> ''").groupBy("stem", F.col("header").alias("id")).agg(F.max_by("seq", F.struct("path", "place")).alias("seq"))


def by_first_word(found: DataFrame) -> DataFrame:
    """(stem, id, seq): the same by the header's first word."""
    return by_header(found.withColumn("header", F.get(F.split("header", r"\s+"), 0)))
