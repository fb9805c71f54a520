"""Queries on trees: suppliers by region and nation, and by bands of their balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeweave.jobs.concordance import uniform_sql
from typeweave.operators import tree as T
from typeweave.sources.tables import handed_over, table

_COLS = ["tree", "node", "parent", "name", "length", "confidence"]


def _leaf_rows(spark, sf_dir):
    """(tree, k, top, mid, lengths of the three levels, confidence of mid)."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    k, n, r = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_regionkey")
    top, mid = F.floor((F.col("s_acctbal") + 1000) / 2500).cast("int"), F.floor((F.col("s_acctbal") + 1000) / 500).cast("int")
    geo = s.select(
        F.lit("geo").alias("tree"), k.alias("k"), (r + 1).alias("top"), (n + 100).alias("mid"), (1 + r * 0.5).alias("l1"), (1 + n % 7 * 0.25).alias("l2"),
        F.when(k % 13 != 0, 0.5 + k % 10 * 0.125).alias("l3"), (n * 4 % 101).cast("double").alias("c"),
    )
    bal = s.select(
        F.lit("bal").alias("tree"), k.alias("k"), (top + 1000).alias("top"), (mid + 10_000).alias("mid"), F.lit(1.0).alias("l1"), (0.5 + mid % 4 * 0.25).alias("l2"),
        (0.25 + k % 5 * 0.125).alias("l3"), (mid * 7 % 101).cast("double").alias("c"),
    )
    return geo.unionByName(bal)


def nodes(spark, sf_dir):
    rows = _leaf_rows(spark, sf_dir)
    leaf_id = (F.col("k") + 1_000_000).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    root = rows.select("tree", F.lit(0).alias("node"), none("int").alias("parent"), none("string").alias("name"), none("double").alias("length"), none("double").alias("confidence"))
    top = rows.select("tree", F.col("top"), F.lit(0), none("string"), "l1", none("double"))
    mid = rows.select("tree", "mid", "top", none("string"), "l2", "c")
    leaf = rows.select("tree", leaf_id, "mid", F.lpad(F.col("k").cast("string"), 8, "0"), "l3", none("double"))
    edges = root.distinct().union(top.distinct()).union(mid.distinct()).union(leaf)
    return handed_over(T.node_table(edges, 3), "nodes")


def _kept(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("name"))


def q_tree_rootdist(spark, sf_dir):
    return nodes(spark, sf_dir).select("tree", "node", "root_dist", "depth")


def q_tree_patristic(spark, sf_dir):
    found = nodes(spark, sf_dir)
    return T.total_distances(found, T.leaves(found)).select("tree", "name", F.round("total", 6).alias("total"))


def _splits(spark, sf_dir):
    found = nodes(spark, sf_dir)
    return handed_over(T.splits(found, T.leaves(found)), "splits")


def q_tree_splits(spark, sf_dir):
    return _splits(spark, sf_dir).select("tree", "node", "size", F.round("p", 8).alias("p"))


def q_tree_rf(spark, sf_dir):
    return T.robinson_foulds(_splits(spark, sf_dir), "geo", "bal")


def q_tree_cid(spark, sf_dir):
    found = _splits(spark, sf_dir)
    two = lambda f, kind: f(found, "geo", "bal").select(F.lit(kind).alias("kind"), "cid")
    return two(T.clustering_information, "distinct").unionByName(two(T.clustering_information_listed, "listed"))


def q_tree_prune(spark, sf_dir):
    return T.pruned(nodes(spark, sf_dir), _kept(spark, sf_dir)).select("tree", "node", "parent", "root_dist", "is_leaf", "depth")


def q_tree_resolution(spark, sf_dir):
    return T.resolution(T.pruned(nodes(spark, sf_dir), _kept(spark, sf_dir)))


def q_median_support(spark, sf_dir):
    return T.support(nodes(spark, sf_dir))


def _leaves_and_balances(spark, sf_dir):
    found = nodes(spark, sf_dir).where("tree = 'geo'")
    balance = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("name"), F.round("s_acctbal", 2).alias("v"))
    return found, T.leaves(found), balance


def q_mantel(spark, sf_dir):
    """Patristic distances against gaps between balances, over all pairs of suppliers."""
    return T.mantel_of_leaves(*_leaves_and_balances(spark, sf_dir))


def q_mantel_perm(spark, sf_dir):
    return T.mantel_permutations_of_leaves(*_leaves_and_balances(spark, sf_dir), 9_999)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_U = """g AS (SELECT s_suppkey k, s_acctbal bal, s_nationkey n, n_regionkey r, floor((s_acctbal+1000)/2500)::int bt, floor((s_acctbal+1000)/500)::int bm FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT 'geo' tree, k, bal, lpad(k::varchar, 8, '0') nm, 1+r t, 100+n m, (1+r*0.5)::double l1, (1+(n%7)*0.25)::double l2, (CASE WHEN k%13 <> 0 THEN 0.5+(k%10)*0.125 ELSE 0 END)::double l3, (n*4%101)::double c FROM g
 UNION ALL SELECT 'bal', k, bal, lpad(k::varchar, 8, '0'), 1000+bt, 10000+bm, 1.0, 0.5+(bm%4)*0.25, 0.25+(k%5)*0.125, (bm*7%101)::double FROM g)"""
_PAIRS = "d AS (SELECT x.tree, x.nm a, y.nm b, x.l1+x.l2+x.l3+y.l1+y.l2+y.l3 - 2*(CASE WHEN x.m = y.m THEN x.l1+x.l2 WHEN x.t = y.t THEN x.l1 ELSE 0 END) dist, abs(round(x.bal, 2)-round(y.bal, 2)) gap FROM u x JOIN u y ON x.tree = y.tree AND x.nm <> y.nm)"
_SPL = """an AS (SELECT tree, nm, t node FROM u UNION ALL SELECT tree, nm, m FROM u UNION ALL SELECT tree, nm, 0 FROM u),
bn AS (SELECT tree, node, count(*) k, list_sort(list(nm)) side, (SELECT min(nm) FROM u) ref FROM an GROUP BY tree, node), al AS (SELECT tree, count(*) n, list_sort(list(nm)) every FROM u GROUP BY tree),
sp AS (SELECT tree, node, k::double/n p, CASE WHEN list_contains(side, ref) THEN list_sort(list_filter(every, lambda x: NOT list_contains(side, x))) ELSE side END side FROM bn JOIN al USING (tree) WHERE k > 1 AND n-k > 1)"""
_H = "(CASE WHEN {0} > 0 AND {0} < 1 THEN -({0}*log2({0}) + (1-{0})*log2(1-{0})) ELSE 0 END)"
_PRUNE = """w AS (SELECT * FROM u WHERE bal >= 0),
mk AS (SELECT tree, m, any_value(t) t, any_value(l1+l2) d, any_value(c) c, count(*) k FROM w GROUP BY tree, m),
ms AS (SELECT * FROM mk WHERE k >= 2), tk AS (SELECT tree, t, any_value(d0) d, count(*) k FROM (SELECT DISTINCT tree, t, m, l1 d0 FROM w) GROUP BY tree, t), ts AS (SELECT * FROM tk WHERE k >= 2),
rt AS (SELECT tree, count(DISTINCT t) k FROM w GROUP BY tree)"""
ORACLE_SQL = {
    "q_tree_rootdist": f"""WITH {_U} SELECT DISTINCT tree, 0 AS node, 0.0::double AS root_dist, 0 AS depth FROM u UNION ALL SELECT DISTINCT tree, t::int, l1, 1 FROM u UNION ALL SELECT DISTINCT tree, m::int, l1+l2, 2 FROM u
UNION ALL SELECT tree, (1000000+k)::int, l1+l2+l3, 3 FROM u""",
    "q_tree_patristic": f"WITH {_U}, {_PAIRS} SELECT tree, a AS name, round(sum(dist), 6) AS total FROM d GROUP BY tree, a",
    "q_tree_splits": f"WITH {_U}, {_SPL} SELECT tree, node::int AS node, len(side) AS size, round(p, 8) AS p FROM sp",
    "q_tree_rf": f"""WITH {_U}, {_SPL}, x AS (SELECT DISTINCT side FROM sp WHERE tree = 'geo'), y AS (SELECT DISTINCT side FROM sp WHERE tree = 'bal'), c AS (SELECT (SELECT count(*) FROM x) a, (SELECT count(*) FROM y) b, (SELECT count(*) FROM x JOIN y USING (side)) s)
SELECT a+b-2*s AS rf, round((a+b-2*s)::double/(a+b), 8) AS nrf, s AS shared FROM c""",
    "q_tree_cid": f"""WITH {_U}, {_SPL}, q AS (SELECT tree, side, min(least(p, 1-p)) p FROM sp GROUP BY tree, side),
h AS (SELECT (SELECT sum({_H.format('p')}) FROM q WHERE tree = 'geo') h1, (SELECT sum({_H.format('p')}) FROM q WHERE tree = 'bal') h2, coalesce((SELECT sum({_H.format('((x.p+y.p)/2)')}) FROM q x JOIN q y USING (side) WHERE x.tree = 'geo' AND y.tree = 'bal'), 0) hs),
z AS (SELECT tree, side, max_by(p, node) p FROM sp GROUP BY tree, side),
i AS (SELECT (SELECT sum({_H.format('p')}) FROM sp WHERE tree = 'geo') h1, (SELECT sum({_H.format('p')}) FROM sp WHERE tree = 'bal') h2, coalesce((SELECT sum({_H.format('((x.p+y.p)/2)')}) FROM z x JOIN z y USING (side) WHERE x.tree = 'geo' AND y.tree = 'bal'), 0) hs)
SELECT 'distinct' AS kind, round(greatest(0, least(1, 1-2*hs/(h1+h2))), 8) AS cid FROM h UNION ALL SELECT 'listed', round(greatest(0, least(1, 1-2*hs/(h1+h2))), 8) FROM i""",
    "q_median_support": f"""WITH {_U}, n AS (SELECT DISTINCT tree, m, c FROM u)
SELECT tree, count(c) AS n, round(median(c), 8) AS median, round(100.0*avg((c >= 70)::int), 8) AS over_70, round(100.0*avg((c >= 90)::int), 8) AS over_90 FROM n GROUP BY tree""",
    "q_tree_resolution": f"""WITH {_U}, {_PRUNE}, c AS (SELECT tree, (SELECT count(*) FROM ms WHERE ms.tree = w.tree) + (SELECT count(*) FROM ts WHERE ts.tree = w.tree) + (SELECT (k >= 2)::int FROM rt WHERE rt.tree = w.tree) AS i, count(*) - 1 most FROM w GROUP BY tree)
SELECT tree, i::bigint AS internal, most, round(100.0::double*i/most, 8) AS index FROM c""",
    "q_mantel": f"WITH {_U}, {_PAIRS} SELECT round(corr(dist, gap), 8) AS r, count(*) AS pairs FROM d WHERE tree = 'geo' AND a < b",
    # The name at place i of a permutation's order stands in for name i; 0 is the identity.
    "q_mantel_perm": f"""WITH {_U}, {_PAIRS}, ids AS (SELECT nm, row_number() OVER (ORDER BY nm) - 1 AS i FROM u WHERE tree = 'geo'), n AS (SELECT count(*) AS n FROM ids),
e AS (SELECT x.i, y.i AS j, dist AS x, gap AS y FROM d JOIN ids x ON x.nm = d.a JOIN ids y ON y.nm = d.b WHERE d.tree = 'geo'),
h AS MATERIALIZED ({uniform_sql('SELECT rep::bigint AS rep, v::bigint AS v FROM range(1, 10000) r(rep), (SELECT i AS v FROM ids)', 42)}),
w AS MATERIALIZED (SELECT 0 AS rep, i, i AS p FROM ids UNION ALL SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY u, v) - 1, v FROM h),
s AS (SELECT a.rep, sum(f.x * e.y) AS xy FROM e JOIN w a ON a.i = e.i JOIN w b ON b.rep = a.rep AND b.i = e.j JOIN e f ON f.i = a.p AND f.j = b.p WHERE e.i < e.j GROUP BY a.rep),
o AS (SELECT xy AS seen FROM s WHERE rep = 0), m AS (SELECT corr(x, y) AS r FROM e WHERE i < j)
SELECT round(any_value(r), 8) AS r, (count(*) FILTER (rep > 0 AND xy >= seen - abs(seen) * 1e-12) + 1) / 10000.0::double AS p, count(*) - 1 AS permutations FROM s, o, m""",
    "q_tree_prune": f"""WITH {_U}, {_PRUNE}, f AS (SELECT tree, k >= 2 rooted FROM rt), tt AS (SELECT tree, t, d FROM ts),
un AS (SELECT tree, 0 node, NULL::int parent, 0.0::double root_dist, false is_leaf, 0 AS "depth" FROM f WHERE rooted
 UNION ALL SELECT tree, t, 0, d, false, 1 FROM tt
 UNION ALL SELECT ms.tree, m, CASE WHEN tt.t IS NULL THEN 0 ELSE tt.t END, ms.d, false, CASE WHEN tt.t IS NULL THEN 1 ELSE 2 END FROM ms LEFT JOIN tt ON tt.tree = ms.tree AND tt.t = ms.t
 UNION ALL SELECT w.tree, (1000000+w.k)::int, CASE WHEN ms.m IS NOT NULL THEN ms.m WHEN tt.t IS NOT NULL THEN tt.t ELSE 0 END, w.l1+w.l2+w.l3, true, 1 + (ms.m IS NOT NULL)::int + (tt.t IS NOT NULL)::int
  FROM w LEFT JOIN ms ON ms.tree = w.tree AND ms.m = w.m LEFT JOIN tt ON tt.tree = w.tree AND tt.t = w.t)
SELECT tree, node::int AS node, parent::int AS parent, root_dist, is_leaf, "depth"::int AS depth FROM un""",
}
