"""Spreadsheets in their zipped form (.xlsx), written and read without a library for them.

Written sheets have their texts in the cells; read ones may have them in a table of shared
strings. A workbook is parsed by one task, row by row: what is held is the zipped file, its
shared strings and one row. Many workbooks are many tasks.

Defined results: a cell that is absent is null, an empty text an empty text; characters that
XML can't hold, and texts that look like their escapes, come back as they were; dates are the
numbers that the sheet has; rows without cells are left out; a number is written and read as
text; a header without a text is ``Unnamed: k``, and one that stands there before gets ``.1``,
``.2`` and so on; an empty table is a sheet with a header alone. Files with another header
than the others, and cells beyond the header, are errors.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.operators.names import unused
from typeweave.operators.offsets import placed
from typeweave.sources.delimited import READINGS

ROWS, BATCH = 1_000_000, 1_000  # data rows of a workbook, rows handed on at once
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: The parts of a workbook with one sheet, but for the sheet.
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_BARRED = [*range(0x09), 0x0B, 0x0C, *range(0x0D, 0x20), 0xFFFE, 0xFFFF]


def _escaped(c: Column) -> Column:
    c = F.regexp_replace(c, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    barred = c
    for code in _BARRED:
        barred = F.replace(barred, F.lit(chr(code)), F.lit(f"_x{code:04X}_"))
    return F.when(c.rlike(r"[\x00-\x08\x0B-\x1F￾￿]"), barred).otherwise(c)


def _cell(kind: Column, text: Column) -> Column:
    inline = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(text), F.lit("</t></is></c>"))
    plain = F.concat(F.when(kind == "b", F.lit('<c t="b"><v>')).otherwise(F.lit("<c><v>")), text, F.lit("</v></c>"))
    return F.when(text.isNull(), F.lit("<c/>")).when(kind == "s", inline).otherwise(plain)


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("<row>"), F.array_join(F.transform(F.array(*cells), lambda c: _cell(c["kind"], c["text"])), ""), F.lit("</row>"))


def _typed(df: DataFrame) -> list[Column]:
    """Each column as (kind, text): ``n`` for what a sheet takes as a number, ``b`` for flags, ``s`` for all else."""
    out = []
    for name, of in df.dtypes:
        c = F.col(f"`{name.replace('`', '``')}`")
        text = c.cast("string")
        if of in ("float", "double"):
            kind = F.when(F.isnan(c) | F.abs(c).isin(float("inf")), "s").otherwise("n")
        elif of == "boolean":
            kind, text = F.lit("b"), c.cast("int").cast("string")
        else:
            kind = F.lit("n" if of in ("tinyint", "smallint", "int", "bigint") or of.startswith("decimal") else "s")
        out.append(F.struct(kind.alias("kind"), text.alias("text")))
    return out


def spreadsheets(df: DataFrame, order: list[str], folder: str, stem: str = "book", most: int = ROWS) -> None:
    """The rows, in ``order`` (which is total), as workbooks of at most ``most`` rows: STEM-00000.xlsx and so on.

    Tasks write the rows' XML, which is zipped as it is copied, in blocks, to a name of its own; each workbook
    is renamed when it is whole, and one that stands there is replaced.
    """
    spark = df.sparkSession
    at, book = unused(df.columns, "at", "book")
    ranked = placed(df, [], [F.col(c) for c in order], at)
    lines = ranked.select(F.expr(f"{at} div {most}").alias(book), at, _row(_typed(df)).alias("value"))
    head = spark.range(1).select(_row([F.struct(F.lit("s").alias("kind"), F.lit(c).alias("text")) for c in df.columns]).alias("value")).first()["value"]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    parts = f"{folder}/.{stem}-{uuid.uuid4().hex}"
    system = path(folder).getFileSystem(conf)
    try:
        lines.repartitionByRange(book, at).sortWithinPartitions(book, at).select(book, "value").write.partitionBy(book).text(parts)
        books = {int(f.getPath().getName().rpartition("=")[2]): f.getPath() for f in system.listStatus(path(parts)) if f.isDirectory()}
        for k, pieces in sorted((books or {0: None}).items()):
            _zipped(jvm, system, head, pieces, path(f"{parts}/joined"), path(f"{folder}/{stem}-{k:05d}.xlsx"))
    finally:
        system.delete(path(parts), True)


def _zipped(jvm, system, head: str, pieces, joined, target) -> None:
    out = jvm.java.util.zip.ZipOutputStream(system.create(joined, True))

    def put(name: str, text: str) -> None:
        out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        out.write(bytearray((_XML + text).encode()))

    try:
        for name, text in _PARTS.items():
            put(name, text)
            out.closeEntry()
        put("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{head}\n')
        for piece in sorted(str(f.getPath()) for f in system.listStatus(pieces) if f.getPath().getName().startswith("part-")) if pieces else ():
            read = system.open(jvm.org.apache.hadoop.fs.Path(piece))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
            finally:
                read.close()
        out.write(bytearray(b"</sheetData></worksheet>"))
        out.closeEntry()
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(joined, target):
        raise OSError(f"can't rename to {target}")


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, of all its runs but phonetic ones, with escapes undone."""
    runs = [t.text or "" for e in element for t in ([e] if e.tag == f"{{{_MAIN}}}t" else e.findall(f"{{{_MAIN}}}t") if e.tag == f"{{{_MAIN}}}r" else [])]
    return _unescaped("".join(runs))


def _unescaped(text: str) -> str:
    return re.sub("_x((?![dD][89A-Fa-f])[0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def parsed(content: bytes, name: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of each row of the named sheet, or the first."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
        wanted = next((s.get(f"{{{_OFFICE}}}id") for s in sheets if name in (None, s.get("name"))), None)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        if wanted not in targets:
            raise ValueError(f"no sheet {name or ''}")
        target = targets[wanted]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as strings:
                for _, item in ElementTree.iterparse(strings):
                    if item.tag == f"{{{_MAIN}}}si":
                        shared.append(_text(item))
                        item.clear()
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            held, at = None, 0
            for event, element in ElementTree.iterparse(sheet, ("start", "end")):
                if event == "start":
                    held = element if element.tag == f"{{{_MAIN}}}sheetData" else held
                elif element.tag == f"{{{_MAIN}}}row":
                    at = int(element.get("r", at + 1))
                    if cells := _cells(element, shared):
                        yield at, cells
                    held.clear()  # what is parsed isn't kept


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for cell in row:
        place = len(out)
        if ref := cell.get("r"):
            place = 0
            for letter in re.match("[A-Z]+", ref)[0]:
                place = place * 26 + ord(letter) - 64
            place -= 1
        out += [None] * (place + 1 - len(out))
        kind, value, inline = cell.get("t", "n"), cell.find(f"{{{_MAIN}}}v"), cell.find(f"{{{_MAIN}}}is")
        if inline is not None:
            out[place] = _text(inline)
        elif value is not None:
            text = value.text or ""
            out[place] = shared[int(text)] if kind == "s" else _unescaped(text) if kind == "str" else text
    return out


def rows(spark: SparkSession, path: str, name: str | None = None, part: str = "all") -> DataFrame:
    """(file, at, cells) of all rows of the workbooks under ``path``, of each one's ``first`` row or of the ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                held = []
                for row in islice(parsed(content.as_py(), name), int(part == "rest"), 1 if part == "first" else None):
                    held.append(row)
                    if len(held) == BATCH:
                        yield made(file.as_py(), held)
                        held = []
                if held:
                    yield made(file.as_py(), held)

    def made(file: str, held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([a for a, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], ["file", "at", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, at long, cells array<string>")


def header(cells: list[str | None]) -> list[str]:
    """Column names from a first row."""
    out: list[str] = []
    for k, cell in enumerate(cells):
        name = plain = cell or f"Unnamed: {k}"
        again = 0
        while name in out:
            again += 1
            name = f"{plain}.{again}"
        out.append(name)
    return out


def sheet(spark: SparkSession, path: str, missing: str = "usual", name: str | None = None) -> DataFrame:
    """All columns of the workbooks under ``path`` as strings; ``missing`` as for ``delimited.csv``."""
    heads = rows(spark, path, name, "first").select("cells").distinct().limit(2).collect()
    if len(heads) != 1:
        raise ValueError(f"{path} has {'more than one header' if heads else 'no header'}")
    names = header(heads[0]["cells"])
    data = rows(spark, path, name, "rest")
    beyond = F.size("cells") > len(names)
    cells = F.when(beyond, F.raise_error(F.concat(F.lit("cells beyond the header in "), "file"))).otherwise(F.col("cells"))
    data = data.select(cells.cast("array<string>").alias("cells"))
    return data.select(*(READINGS[missing](F.get("cells", k)).alias(n) for k, n in enumerate(names)))
