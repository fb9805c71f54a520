"""Line lists, hit tables and CSV files, with three readings of what is missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.operators.seq import trimmed

#: What CSV readers of data frames take for a missing value.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: The fields of a hit table, which has no header.
HIT_FIELDS = "sseqid string, pident double, length int, qlen int, sstart int, send int, sstrand string, bitscore double"

#: What is null of a cell's text.
READINGS = {
    "usual": lambda c: F.when(~c.isin(NA), c),
    "empty": lambda c: F.when(c != "", c),
    "never": lambda c: F.coalesce(c, F.lit("")),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a list file, without white space around it and without blank lines."""
    return spark.read.text(path).select(trimmed(F.regexp_replace("value", "^﻿", "")).alias("line")).where("line <> ''")


def hits(spark: SparkSession, path: str) -> DataFrame:
    """HIT_FIELDS and position of each line with that many tab-separated fields or more; shorter ones are left out, and a field that isn't a number is an error."""
    kinds = [f.split() for f in HIT_FIELDS.split(", ")]
    read = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("position"))
    return read.where(F.size("f") >= len(kinds)).select(*(F.get("f", k).cast(kind).alias(name) for k, (name, kind) in enumerate(kinds)), "position")


def _column(name: str) -> Column:
    """A column by its header, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_names(names: Iterable[str]) -> list[str]:
    """Of each header its first line, without a byte-order mark and white space around it."""
    return [n.replace("﻿", "").strip().split("\n")[0].strip() for n in names]


def csv(spark: SparkSession, path: str, missing: str = "usual", multi_line: bool = False) -> DataFrame:
    """All columns of a CSV file with a header, as strings; headers keep further lines, without a byte-order mark.

    ``missing`` says what is null: ``usual`` any of NA, ``empty`` an empty cell, ``never`` nothing, so
    that the text NA is a value and an empty cell an empty text.
    """
    read = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = read.toDF(*(n.replace("﻿", "").strip() for n in read.columns))
    return read.select(*(READINGS[missing](_column(n)).alias(n) for n in read.columns))


def without_missing_data(df: DataFrame, flag: str = "has_missing_data", label: str = "ST") -> DataFrame:
    """Rows that aren't flagged ``yes``; in a table without the flag, those whose label isn't the text NA."""
    column, odd = (flag, "yes") if flag in df.columns else (label, "NA")
    return df.where(F.col(column).isNull() | (F.col(column) != odd))


def family(df: DataFrame, suffix: str, but_not: tuple[str, ...] = ()) -> list[str]:
    """The columns whose header ends with the suffix and whose first line doesn't start with any of the others."""
    return [c for c in df.columns if c.endswith(suffix) and not clean_names([c])[0].startswith(but_not or ("\0",))]


def packed(df: DataFrame, columns: list[str]) -> Column:
    """Columns as one array of numbers; what isn't a number is null."""
    return F.array(*(_column(c).try_cast("double") for c in columns))


def wide_export(spark: SparkSession, path: str, keys: list[str], suffix: str, but_not: tuple[str, ...] = ()) -> DataFrame:
    """The key columns (by the first line of their headers) and ``profile``, the family's values, of an export of many columns with headers of several lines."""
    read = csv(spark, path, missing="empty", multi_line=True)
    by_name = dict(zip(clean_names(read.columns), read.columns))
    return read.select(*(trimmed(_column(by_name[k])).alias(k) for k in keys), packed(read, family(read, suffix, but_not)).alias("profile"))
