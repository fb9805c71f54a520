"""Files for other programs. Tables are folders of parts, as Spark writes them; what other programs open by name is one file."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.sources.tables import handed_over


def one_file(lines: DataFrame, path: str) -> None:
    """The one text column of ``lines``, in the order of its partitions, as one file of that name.

    Tasks write parts beside it, which are joined byte by byte, in order, under a name of its own and
    then renamed: until then nothing stands at ``path``, a failed task leaves nothing there, and a rerun
    replaces it as a whole. No part is held in memory; any file system that Spark writes to will do.
    """
    spark = lines.sparkSession
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    name = f"{path}.{uuid.uuid4().hex}"
    parts, joined, target = (hadoop.fs.Path(p) for p in (f"{name}.parts", f"{name}.joined", path))
    system = target.getFileSystem(conf)
    try:
        lines.write.text(f"{name}.parts")
        out = system.create(joined)
        try:
            for part in sorted(str(f.getPath()) for f in system.listStatus(parts) if f.getPath().getName().startswith("part-")):
                piece = system.open(hadoop.fs.Path(part))
                try:
                    hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
                finally:
                    piece.close()
        finally:
            out.close()
        system.delete(target, True)
        if not system.rename(joined, target):
            raise OSError(f"can't rename to {path}")
    finally:
        for left in (parts, joined):
            system.delete(left, True)


def appended_tsv(df: DataFrame, path: str) -> None:
    """Adds the rows to a tab-separated table; each part has the header."""
    df.write.mode("append").csv(path, sep="\t", header=True)


def _record(key: str, seq: str) -> Column:
    return F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq))


def fasta(df: DataFrame, key: str, seq: str, path: str, by: str | None = None) -> None:
    """Sequences by key; ``by`` gives each of its values a folder of its own."""
    rows = df.select(*([by] if by else []), _record(key, seq).alias("value"))
    (rows.write.partitionBy(by) if by else rows.write).text(path)


def concatenated_fasta(df: DataFrame, key: str, seq: str, folder: str, scheme: str) -> str:
    """Joined sequences, in the order of their keys, in a file that is named with their number; its path."""
    df = handed_over(df.select(key, seq), "concatenated")
    path = f"{folder}/concat_{scheme}_{df.count()}.fasta"
    one_file(df.orderBy(key).select(_record(key, seq).alias("value")), path)
    return path


def partition_file(blocks: DataFrame, name: str, path: str) -> None:
    """``DNA, NAME = FIRST-LAST`` of each block, from ``seq.partitions``."""
    one_file(blocks.orderBy("first").select(F.format_string("DNA, %s = %d-%d", F.col(name), F.col("first").cast("bigint"), F.col("last").cast("bigint")).alias("value")), path)


def records(df: DataFrame, path: str) -> None:
    """A CSV of records: flags as yes and no, lists joined by ``;``, what is missing as NA."""
    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "yes").when(~c, "no")
        elif kind.startswith("array"):
            c = F.array_join(c, ";")
        return F.coalesce(c.cast("string"), F.lit("NA")).alias(name)

    df.select(*(cell(n, k) for n, k in df.dtypes)).write.csv(path, header=True, emptyValue="")


def metrics(df: DataFrame, keys: list[str], path: str) -> None:
    """All values as text, one row for each metric of each key: (keys..., metric, value)."""
    values = [c for c in df.columns if c not in keys]
    text = df.select(*keys, *(F.col(c).cast("string").alias(c) for c in values))
    text.unpivot(keys, values, "metric", "value").write.csv(path, header=True)


def catalogue(rows: DataFrame, members: DataFrame, folder: str) -> None:
    """The catalogue and each entity's type: two tables from one plan, which is run once."""
    rows = handed_over(rows, "catalogue")
    records(rows, f"{folder}/catalogue.csv")
    records(members.join(rows.select("profile", "pst"), "profile", "left").select("entity", "pst"), f"{folder}/entities.csv")


def report(df: DataFrame, widths: dict[str, int], title: str, path: str) -> None:
    """A title, a header and a line of fixed width for each row of a small summary; numbers stand at the right."""
    texts = {n: k == "string" for n, k in df.dtypes}
    pad = lambda c, name: F.rpad(c, widths[name], " ") if texts[name] else F.lpad(c, widths[name], " ")
    line = F.concat(*(pad(F.coalesce(F.col(n).cast("string"), F.lit("-")), n) for n in widths))
    head = "".join(n.ljust(w) if texts[n] else n.rjust(w) for n, w in widths.items())
    first = df.sparkSession.createDataFrame([(0, title), (1, head)], "at int, value string")
    one_file(first.unionByName(df.select(F.lit(2).alias("at"), line.alias("value"))).orderBy("at", "value").select("value"), path)
