"""Functions from one value to many rows, for SQL with LATERAL.

``registered(spark)`` makes them known to a session:

    SELECT t.tree, n.* FROM trees t, LATERAL newick_nodes(t.newick) n
    SELECT s.strain, l.* FROM strains s, LATERAL locus_rows(s.seq, array(named_struct('locus', 'arcC', 'first', 1, 'last', 456))) l
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from typeweave.sources.newick import closed_nodes, number


class NewickNodes:
    """A node as soon as it is closed: nothing but the way to the open node is held, however large the tree."""

    def eval(self, newick: str) -> Iterator[tuple]:
        for node, parent, label, length, leaf, last, depth in closed_nodes(newick or ""):
            yield node, parent, label if leaf else None, length, None if leaf else number(label), leaf, node, last, depth


class LocusRows:
    """A row for each range of a sequence, 1-based and inclusive, in upper case; a range that the sequence doesn't fill is missing and has no row."""

    def eval(self, seq: str, loci: list) -> Iterator[tuple]:
        for locus in loci or []:
            if seq is not None and 1 <= locus["first"] <= locus["last"] <= len(seq):
                yield locus["locus"], seq[locus["first"] - 1 : locus["last"]].translate(_UPPER), locus["last"] - locus["first"] + 1


_UPPER = {c: c - 32 for c in range(97, 123)}


def registered(spark: SparkSession) -> None:
    """newick_nodes(text) and locus_rows(seq, loci) in the session's SQL."""
    spark.udtf.register("newick_nodes", udtf(NewickNodes, returnType="node int, parent int, name string, length double, confidence double, is_leaf boolean, first bigint, last bigint, depth int"))
    spark.udtf.register("locus_rows", udtf(LocusRows, returnType="locus string, seq string, length int"))
