"""Queries on dictionaries, profiles, types and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeweave.operators import encode as E
from typeweave.sources.tables import table

LOCI = ["p_type", "p_brand", "p_size"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _part_long(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), *(F.col(c).cast("string").alias(c) for c in LOCI))
    return part.unpivot(["entity"], LOCI, "locus", "value")


def _orders_long(spark, sf_dir):
    """Customers by the statuses of their orders: a locus is a status, its value the least priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("locus")).agg(F.min("o_orderpriority").alias("value"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))


def q_freq_dict(spark, sf_dir):
    return E.frequency_dictionary(_part_long(spark, sf_dir), "entity")


def q_first_seen_dict(spark, sf_dir):
    return E.first_seen_dictionary(_part_long(spark, sf_dir), "entity")


def q_st_assign(spark, sf_dir):
    return E.sequence_types(_customers(spark, sf_dir), _orders_long(spark, sf_dir), ["F", "O", "P"])


def q_st_assign_names(spark, sf_dir):
    """The same by names in place of numbers, and with a scheme whose order isn't that of its loci."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    long = _orders_long(spark, sf_dir).join(names, "entity").select(F.col("name").alias("entity"), "locus", "value")
    types = E.sequence_types(names.select(F.col("name").alias("entity")), long, ["P", "F", "O"])
    return types.withColumn("label", E.prefixed("ST", "st"))


def q_complete_dict(spark, sf_dir):
    """Values of customers that have all three statuses, numbered by the first name that has them."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    long = _orders_long(spark, sf_dir).join(names, "entity").select(F.col("name").alias("entity"), "locus", "value")
    return E.complete_dictionary(long, ["F", "O", "P"])


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("locus"), F.lit("x").alias("value"))


def q_missing_loci(spark, sf_dir):
    return E.missing_loci(_customers(spark, sf_dir), _grid(spark, sf_dir), PRIORITIES).select("entity", F.array_join("missing", ";").alias("missing"))


def q_complete_case(spark, sf_dir):
    """Customers with orders of every priority."""
    long = _grid(spark, sf_dir)
    all_loci = long.agg(F.count_distinct("locus").alias("loci"))
    return long.groupBy("entity").agg(F.count_distinct("locus").alias("n")).crossJoin(F.broadcast(all_loci)).where("n = loci").select("entity")


def q_locus_success(spark, sf_dir):
    """How many customers have each priority, and their part of all."""
    total = _customers(spark, sf_dir).agg(F.count_distinct("entity").alias("total"))
    have = _grid(spark, sf_dir).groupBy("locus").agg(F.count_distinct("entity").alias("success"))
    return have.crossJoin(F.broadcast(total)).select("locus", "success", (F.col("total") - F.col("success")).alias("failed"), F.round(100 * F.col("success") / F.col("total"), 6).alias("percent"))


def _members(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("entity"), F.concat_ws("|", "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("profile"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("cluster"), (F.col("p_size") <= 25).alias("in_a"), (F.col("p_retailprice") > 1500).alias("in_l"),
    )


def q_pst_catalogue(spark, sf_dir):
    return E.catalogue(_members(spark, sf_dir)).withColumn("reps", F.array_join("reps", ";"))


def q_top5_reps(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return E.smallest(rows, "p_brand", "p_partkey", 5).select("p_brand", F.array_join("least", ";").alias("reps"))


def q_rep_remap(spark, sf_dir):
    """Types numbered among the smaller parts alone, renamed to those of all parts through representatives."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws("|", "p_brand", "p_type").alias("profile"), "p_size")
    number = lambda rows: E.numbered(rows.groupBy("profile").agg(F.min("entity").alias("first")), "first", "code").select("profile", "code")
    small = part.where("p_size <= 25")
    local = small.join(number(small), "profile").select("entity", F.col("code").alias("local_label"))
    reps = E.smallest(part, "profile", "entity", 5).join(number(part), "profile")
    rows = reps.select(F.col("code").alias("label"), F.col("code").alias("order_no"), F.array_join("least", " ; ").alias("reps"))
    return E.remapped(local, rows).select("local_label", "label", "conflict")


def q_relabel(spark, sf_dir):
    """Parts by their type among the smaller ones, renamed to that of all parts; a type that has no name is null."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.concat_ws("|", "p_brand", "p_type").alias("profile"), "p_size")
    number = lambda rows: E.numbered(rows.groupBy("profile").agg(F.min("entity").alias("first")), "first", "code").select("profile", "code")
    local = part.join(number(part.where("p_size <= 40")), "profile", "left").select("entity", F.col("code").alias("type"))
    mapping = q_rep_remap(spark, sf_dir).where("NOT conflict")
    named = E.relabelled(local, mapping, "type").withColumn("label", E.prefixed("T", "type"))
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_LONG = "l AS (SELECT p_partkey e, unnest(['p_type','p_brand','p_size']) locus, unnest([p_type, p_brand, p_size::varchar]) value FROM part), n AS (SELECT locus, value, count(*) n, min(e) f FROM l WHERE value IS NOT NULL AND value <> '' GROUP BY ALL)"
ORACLE_SQL = {
    "q_freq_dict": f"WITH {_LONG} SELECT locus, value, n, row_number() OVER (PARTITION BY locus ORDER BY n DESC, f, value)::int AS code FROM n",
    "q_first_seen_dict": f"WITH {_LONG} SELECT locus, value, row_number() OVER (PARTITION BY locus ORDER BY f, value)::int AS code FROM n",
    "q_st_assign": """WITH l AS (SELECT o_custkey e, o_orderstatus s, min(o_orderpriority) v FROM orders GROUP BY ALL),
p AS (SELECT c_custkey e, max(v) FILTER (s = 'F') f, max(v) FILTER (s = 'O') o, max(v) FILTER (s = 'P') p FROM customer LEFT JOIN l ON e = c_custkey GROUP BY ALL),
c AS (SELECT *, min(e) OVER (PARTITION BY f, o, p) first, count(*) OVER (PARTITION BY f, o, p) m FROM p WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL),
t AS (SELECT e, dense_rank() OVER (ORDER BY first) st, m FROM c)
SELECT p.e AS entity, t.st, CASE WHEN t.st IS NOT NULL THEN m = 1 END AS is_novel, (f IS NULL OR o IS NULL OR p IS NULL) AS has_missing_data,
 concat_ws(';', CASE WHEN f IS NULL THEN 'F' END, CASE WHEN o IS NULL THEN 'O' END, CASE WHEN p IS NULL THEN 'P' END) AS missing_loci FROM p LEFT JOIN t USING (e)""",
    "q_st_assign_names": """WITH l AS (SELECT o_custkey e, o_orderstatus s, min(o_orderpriority) v FROM orders GROUP BY ALL),
p AS (SELECT c_name e, max(v) FILTER (s = 'F') f, max(v) FILTER (s = 'O') o, max(v) FILTER (s = 'P') p FROM customer LEFT JOIN l ON e = c_custkey GROUP BY ALL),
c AS (SELECT *, min(e) OVER (PARTITION BY f, o, p) first, count(*) OVER (PARTITION BY f, o, p) m FROM p WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL),
t AS (SELECT e, dense_rank() OVER (ORDER BY first) st, m FROM c)
SELECT p.e AS entity, t.st, CASE WHEN t.st IS NOT NULL THEN m = 1 END AS is_novel, (f IS NULL OR o IS NULL OR p IS NULL) AS has_missing_data,
 concat_ws(';', CASE WHEN p IS NULL THEN 'P' END, CASE WHEN f IS NULL THEN 'F' END, CASE WHEN o IS NULL THEN 'O' END) AS missing_loci, 'ST' || st AS label FROM p LEFT JOIN t USING (e)""",
    "q_complete_dict": """WITH l AS (SELECT c_name e, o_orderstatus locus, min(o_orderpriority) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
w AS (SELECT e FROM l WHERE locus IN ('F', 'O', 'P') GROUP BY e HAVING count(*) = 3), f AS (SELECT locus, value, min(e) f FROM l JOIN w USING (e) WHERE locus IN ('F', 'O', 'P') GROUP BY ALL)
SELECT locus, value, row_number() OVER (PARTITION BY locus ORDER BY f, value)::int AS code FROM f""",
    "q_relabel": """WITH p AS (SELECT p_partkey e, concat_ws('|', p_brand, p_type) profile, p_size FROM part),
g AS (SELECT e, profile, p_size, dense_rank() OVER (ORDER BY f) code FROM (SELECT *, min(e) OVER (PARTITION BY profile) f FROM p)),
s AS (SELECT e, dense_rank() OVER (ORDER BY f) local FROM (SELECT *, min(e) OVER (PARTITION BY profile) f FROM p WHERE p_size <= 25)),
r AS (SELECT code, e FROM (SELECT code, e, row_number() OVER (PARTITION BY code ORDER BY e) i FROM g) WHERE i <= 5),
j AS (SELECT code, count(DISTINCT local) k, min(local) local FROM r JOIN s USING (e) GROUP BY code),
m AS (SELECT local, max(code) label FROM j GROUP BY local HAVING NOT bool_or(k > 1)),
b AS (SELECT profile, dense_rank() OVER (ORDER BY f) code FROM (SELECT profile, min(e) f FROM p WHERE p_size <= 40 GROUP BY profile))
SELECT 'T' || label AS label, count(*) AS n, min(e) AS first FROM p LEFT JOIN b USING (profile) LEFT JOIN m ON m.local = b.code GROUP BY label""",
    "q_missing_loci": """WITH l AS (SELECT DISTINCT o_orderpriority locus FROM orders WHERE o_orderpriority IS NOT NULL), g AS (SELECT DISTINCT c_custkey entity, locus FROM customer, l)
SELECT entity, string_agg(locus, ';' ORDER BY locus) AS missing FROM g ANTI JOIN orders ON o_custkey = entity AND o_orderpriority = locus GROUP BY entity""",
    "q_complete_case": "SELECT o_custkey AS entity FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)",
    "q_locus_success": """WITH t AS (SELECT count(DISTINCT c_custkey) t FROM customer), s AS (SELECT o_orderpriority locus, count(DISTINCT o_custkey) s FROM orders GROUP BY ALL)
SELECT locus, s AS success, t - s AS failed, round(100.0::double*s/t, 6) AS percent FROM s, t""",
    "q_pst_catalogue": """WITH m AS (SELECT p_partkey e, concat_ws('|', p_type, (p_size//10)::varchar) profile, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END cluster, p_size <= 25 a, p_retailprice > 1500 l FROM part),
s AS (SELECT profile, count(*) n_total, count(cluster) n_overlap, count(*) FILTER (a) n_a, count(*) FILTER (l) n_l, min(e) f FROM m GROUP BY profile),
v AS (SELECT profile, cluster, row_number() OVER (PARTITION BY profile ORDER BY count(*) DESC, cluster) i FROM m WHERE cluster IS NOT NULL GROUP BY profile, cluster),
r AS (SELECT profile, string_agg(e::varchar, ';' ORDER BY e) reps FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY e) i FROM m) WHERE i <= 5 GROUP BY profile)
SELECT row_number() OVER (ORDER BY n_a DESC, n_l DESC, n_total DESC, f)::int AS pst, profile, n_total, n_overlap, cluster,
 CASE WHEN n_overlap > 0 AND n_a = n_overlap THEN 'A' WHEN n_l > 0 THEN 'L' ELSE '' END AS lineage, reps FROM s LEFT JOIN v USING (profile) JOIN r USING (profile) WHERE coalesce(i, 1) = 1""",
    "q_top5_reps": "SELECT p_brand, string_agg(p_partkey::varchar, ';' ORDER BY p_partkey) AS reps FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) i FROM part) WHERE i <= 5 GROUP BY p_brand",
    "q_rep_remap": """WITH p AS (SELECT p_partkey e, concat_ws('|', p_brand, p_type) profile, p_size FROM part),
g AS (SELECT e, profile, p_size, dense_rank() OVER (ORDER BY f) code FROM (SELECT *, min(e) OVER (PARTITION BY profile) f FROM p)),
s AS (SELECT e, dense_rank() OVER (ORDER BY f) local FROM (SELECT *, min(e) OVER (PARTITION BY profile) f FROM p WHERE p_size <= 25)),
r AS (SELECT code, e FROM (SELECT code, e, row_number() OVER (PARTITION BY code ORDER BY e) i FROM g) WHERE i <= 5),
j AS (SELECT code, count(DISTINCT local) k, min(local) local FROM r JOIN s USING (e) GROUP BY code)
SELECT local AS local_label, max(code) AS label, bool_or(k > 1) AS conflict FROM j GROUP BY local""",
}
