"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes. ``BANDS``
times ``ROWS`` MinHash minima give band keys for candidates; of each minimum
only the two low bits are kept, packed into bit planes. The similarity of a
candidate pair is estimated from counts of differing bits, corrected for chance
agreement, and a pair is dropped only where the estimate is ``SLACK`` (six standard
deviations) below the threshold. The others are confirmed on the full sets.

Two documents of similarity 0.8 share no band with a chance of 1.2e-7, and are
dropped by the estimate with one below 1e-8. Otherwise no link is lost:

* Documents with equal sets are one node, so groups of copies cost one document. A
  node is named by two sums over its set, 122 bits as a decimal number; among 5e10
  different sets two share a name with a chance of about 2e-16.
* The nodes of a band key are a bucket. In one of at most ``SMALL`` nodes all pairs are
  candidates, a bounded number for each node.
* Nodes of larger buckets are hot, and their buckets aren't expanded into pairs. First
  each is a candidate with one pivot, the node of its buckets that stands in the most
  and largest ones, which is the middle of a group of near copies. Confirmed links
  make components. Hot nodes that share a bucket with another component are then
  searched exactly (``between``): only shingles that stand in several components
  count, of these a prefix of the rarest is looked up, and by the places of a shingle
  in both sets and the sets' sizes, pairs that can't have the overlap aren't made.

Sets, edges and components stay tables; the driver sees counts and flags.

Defined results: words are split at space and U+0009 to U+000D after A-Z became
a-z; a text with fewer words than a shingle has one, its whole sequence; a null
text or one without words has none and is linked with nothing. Very long texts are
handled whole, as arrays of one task. Rows of one id are
one document, and are linked by any of their texts; repeated rows are one. A row with a
null id is linked with nothing, is kept, and has a null component. Other columns are
left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.llm.arrays import Texts, Words, distinct_by_text, mapped, mixed
from typeweave.operators.components import components
from typeweave.sources.tables import handed_over

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
WORDS64 = -(-HASHES // 64)  # 64-bit words of a bit plane
SLACK = 0.2
SMALL = 8  # nodes of a bucket whose pairs are all candidates
MOST_IDS_SENT = 500_000  # ids that may be broadcast, 8 bytes each
_rng = np.random.default_rng(0xD0C5)
_FLIP = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SLOT = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text's after another's, and where each text's begin."""
    return distinct_by_text(*Words(Texts(column)).shingles(n))


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES minima of each set that isn't empty: an array of shape (sets, HASHES)."""
    starts = at[:-1][np.diff(at) > 0]
    high = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((HASHES, len(starts)), np.uint32)
    if len(starts):
        for k in range(HASHES):
            out[k] = np.minimum.reduceat((high ^ _FLIP[k]) * _TIMES[k], starts)
    return out.T


def sketches(docs: DataFrame, row_id: str, text: str, n: int) -> DataFrame:
    """(row_id, n_shingles, node, planes, bands) of each row; equal sets have one node, and a row without shingles has none."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            sets, at = shingle_sets(batch.column("text"), n)
            size = np.diff(at)
            some = size > 0
            least = minima(sets, at)
            keys = mixed((least.reshape(-1, BANDS, ROWS).astype(np.uint64) * _SLOT).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            padded = np.zeros((len(least), WORDS64 * 64), np.uint8)
            planes = []
            for bit in (0, 1):
                padded[:, :HASHES] = (least >> np.uint32(bit)) & np.uint32(1)
                planes.append(np.packbits(padded, axis=1).view(np.int64))
            packed = np.concatenate(planes, axis=1)
            return {
                "n_shingles": pa.array(size),
                "node": pc.if_else(pa.array(some), _names(sets, at), None),
                "planes": _lists(packed, some),
                "bands": _lists(keys.view(np.int64), some),
            }

        return run

    slim = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return mapped(slim, make, "n_shingles long, node decimal(38,0), planes array<long>, bands array<long>", "text", drop=("text",))


def _names(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """A number of 122 bits for each set: two sums of hashes over its members, the second one's high bits before the first."""
    size = np.diff(at)
    sums = np.zeros((len(size), 2), np.uint64)  # the low and high half of a 128-bit decimal
    if len(sets):
        for k, other in enumerate((5, 11)):
            sums[size > 0, k] = np.add.reduceat(mixed(sets ^ np.uint64(other)), at[:-1][size > 0])
    sums[:, 1] >>= np.uint64(6)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(size), [None, pa.py_buffer(sums.tobytes())])


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    ends = np.cumsum(np.concatenate(([0], some * rows.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two columns of planes: the part of minima with equal low bits, less the quarter that agrees by chance."""
    differ = sum(F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)).bitwiseOR(F.get(a, i + WORDS64).bitwiseXOR(F.get(b, i + WORDS64)))) for i in range(WORDS64))
    return 1 - differ / (HASHES * 0.75)


def set_table(docs: DataFrame, wanted: DataFrame, row_id: str, text: str, n: int) -> DataFrame:
    """(node, members) of the rows whose ids are in ``wanted``: the distinct shingle hashes."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            sets, at = shingle_sets(batch.column("text"), n)
            return {"node": _names(sets, at), "members": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))}

        return run

    # A few ids are sent to the texts; only beyond that are the texts dealt out to the ids.
    ids = F.broadcast(wanted) if wanted.count() <= MOST_IDS_SENT else wanted
    texts = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).join(ids, "row_id", "left_semi")
    return mapped(texts, make, "node decimal(38,0), members array<long>", "text", drop=("text",)).select("node", "members")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose estimate isn't far below the threshold."""
    planes = lambda side: nodes.select(F.col("node").alias(side), F.col("planes").alias(f"planes_{side}"))
    near = estimate(F.col("planes_a"), F.col("planes_b")) >= percent / 100 - SLACK
    return handed_over(pairs.join(planes("a"), "a").join(planes("b"), "b").where(near).select("a", "b"), "likely-pairs")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose full sets have 100 * intersection >= percent * union."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"set_{name}"))
    both, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    # b is the node and a the pivot, so a is the key that can be hot; both sides of its join are splittable.
    return pairs.join(side("b"), "b").join(side("a"), "a").where(100 * both >= percent * (total - both)).select("a", "b")


def _mixed(labelled: DataFrame) -> DataFrame:
    """(node, component) of those that share a bucket with another component."""
    keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return labelled.join(handed_over(keys, "mixed-buckets"), "key", "left_semi").select("node", "component").distinct()


def between(open_nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) among (node, component) rows that hold all links between different components.

    A link needs ``need`` common shingles, and these stand in both components. So a
    node's shingles that stand in one component alone are left out, the others are
    ordered from the rarest, and ``rest`` is how many there are from one on. At the
    first shingle that two linked nodes have in common, both rests are ``need`` at
    least, which also leaves only a prefix of each node's shingles to look up. Sizes
    that are out of reach are ruled out before nodes are met. The component with the
    most nodes of a shingle isn't compared with itself.
    """
    need = lambda n, m: F.ceil(percent * (n + m) / F.lit(100.0 + percent))
    members = sets.select("node", F.size("members").cast("bigint").alias("n"), F.explode("members").alias("shingle"))
    each = handed_over(open_nodes.join(members, "node"), "open-shingles")
    wide = each.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("often")).where("low < high")
    held = each.join(handed_over(wide.select("shingle", "often"), "wide-shingles"), "shingle")
    own = Window.partitionBy("node")  # rows of one set
    rest = F.count(F.lit(1)).over(own) + 1 - F.row_number().over(own.orderBy("often", "shingle"))
    prefix = handed_over(held.withColumn("rest", rest).where(100 * F.col("rest") >= percent * F.col("n")).drop("often"), "prefixes")
    most = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("shingle")
    most = most.agg(F.max(F.struct("k", "component")).alias("most"), F.count(F.lit(1)).alias("components")).where("components > 1").select("shingle", F.col("most.component").alias("most"))
    sizes = handed_over(prefix.groupBy("shingle", F.col("n").alias("m")).agg(F.max("rest").alias("reach")), "prefix-sizes")
    asked = prefix.join(handed_over(most, "prefix-components"), "shingle").where("component <> most")
    asked = handed_over(asked.join(sizes, "shingle").where(F.least("rest", "reach") >= need(F.col("n"), F.col("m"))).drop("reach"), "asked")
    others = prefix.select("shingle", F.col("n").alias("m"), F.col("node").alias("other"), F.col("component").alias("its"), F.col("rest").alias("its_rest"))
    enough = F.least("rest", "its_rest") >= need(F.col("n"), F.col("m"))
    once = (F.col("its") == F.col("most")) | (F.col("node") < F.col("other"))
    found = asked.join(others, ["shingle", "m"]).where((F.col("its") != F.col("component")) & enough & once)
    return found.select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()


def links(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, given: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes with links; ``nodes`` has node, planes and bands, ``given`` edges that hold anyway."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    sized = handed_over(keyed.join(handed_over(buckets.select("key", "size"), "buckets"), "key"), "bucket-members")
    weights = handed_over(sized.groupBy("node").agg(F.sum("size").alias("weight"), (F.max("size") > SMALL).alias("hot")), "weights")
    members = handed_over(sized.join(weights, "node"), "weighed-members")
    large = members.where(F.col("size") > SMALL)
    pivots = handed_over(large.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("pivot")), "pivots")
    stars = large.join(pivots, "key").where("node <> pivot.node").groupBy(F.col("node").alias("b")).agg(F.max("pivot").alias("pivot")).select(F.col("pivot.node").alias("a"), "b")
    small = members.where(F.col("size") <= SMALL).select("key", "node", "hot")
    other = small.select("key", F.col("node").alias("a"), F.col("hot").alias("hot_a"))
    pairs = small.join(other, "key").where("a < node AND NOT (hot AND hot_a)").select("a", F.col("node").alias("b")).distinct()
    near = likely(stars.unionByName(pairs), nodes, percent)
    wanted = weights.where("hot").select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = handed_over(sets_of(handed_over(wanted, "wanted")), "shingle-sets")
    edges = confirmed(near, sets, percent)
    edges = handed_over(edges if given is None else edges.unionByName(given), "links")
    joined = components(edges)
    labelled = members.where("hot").select("key", "node").join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    opened = handed_over(_mixed(labelled), "open-nodes")
    if opened.isEmpty():
        return joined
    more = handed_over(confirmed(likely(between(opened, sets, percent), nodes, percent), sets, percent), "links")
    return joined if more.isEmpty() else components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: row_id, n_shingles, component_id (the least id reachable), kept."""
    sketched = handed_over(sketches(docs, row_id, text, shingle_words), "sketches")
    named = sketched.where("node IS NOT NULL AND row_id IS NOT NULL").groupBy("row_id", "node").agg(F.count(F.lit(1)).alias("times"))
    named = handed_over(named, "named-sets")
    classes = handed_over(named.groupBy("node").agg(F.min("row_id").alias("row_id"), (F.sum("times") > 1).alias("copied")), "classes")
    texts = named.groupBy("row_id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("times").alias("times"))
    odd = handed_over(texts.where("low < high OR times > 1"), "repeated-ids")
    repeated = not odd.isEmpty()
    given = named.join(odd, "row_id").where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct() if repeated else None
    one = lambda df: df.dropDuplicates(["node"]) if repeated else df
    firsts = classes.select("row_id", "node")
    nodes = handed_over(one(sketched.select("row_id", "node", "planes", "bands").join(firsts, ["row_id", "node"], "left_semi").drop("row_id")), "nodes")
    sets_of = lambda wanted: one(set_table(docs, handed_over(firsts.join(wanted, "node").select("row_id").distinct(), "wanted-ids"), row_id, text, shingle_words))
    joined = links(nodes, sets_of, percent, given)
    grouped = handed_over(classes.join(joined, "node", "left").where("copied OR component IS NOT NULL").select("node", "row_id", F.coalesce("component", "node").alias("component")), "linked-classes")
    least = handed_over(grouped.groupBy("component").agg(F.min("row_id").alias("least")), "least-ids")
    least = handed_over(grouped.join(least, "component").select("node", "least"), "components")
    return (
        sketched.select("row_id", "n_shingles", "node").join(least, "node", "left")
        .select("row_id", "n_shingles", F.when(F.col("row_id").isNotNull(), F.coalesce("least", "row_id")).alias("component_id"))
        .withColumn("kept", F.col("row_id").isNull() | (F.col("row_id") == F.col("component_id")))
    )
