"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.sources.tables import discarded, handed_over


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node that an edge names; component is the component's least node.

    Labels fall along edges and then along labels (a node takes the label of
    its label), so the rounds grow with the logarithm of the longest path on
    most graphs. Labels only ever fall, so the rounds end; superseded labels are
    removed. Edges and labels stay tables; the driver sees one flag a
    round. A node with very many edges is spread by skew joins: both sides of
    each join are read from written tables.

    Rows with a null are left out; loops and repeated edges are allowed; no
    edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = handed_over(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = handed_over(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels")
    while True:
        offered = (
            both.join(labels, both.b == labels.node)
            .groupBy(both.a.alias("node")).agg(F.min("component").alias("offered"))
        )
        fallen = handed_over(
            labels.join(offered, "node", "left").select(
                "node", F.least("component", F.coalesce("offered", "component")).alias("component"),
                (F.col("offered") < F.col("component")).alias("fell"),
            ),
            "labels",
        )
        discarded(labels)
        if fallen.where("fell").isEmpty():
            discarded(both)
            return fallen.select("node", "component")
        next_of = fallen.select(F.col("node").alias("_node"), F.col("component").alias("_next"))
        labels = handed_over(
            fallen.join(next_of, fallen.component == next_of._node, "left").select(
                "node", F.least("component", F.coalesce("_next", "component")).alias("component")
            ),
            "labels",
        )
        discarded(fallen)
