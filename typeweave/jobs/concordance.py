"""Queries on the agreement of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.operators import distance as D
from typeweave.operators import partition as P
from typeweave.operators.encode import prefixed
from typeweave.sources.tables import handed_over, table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.floor(F.col("p_size") / 10).alias("p_band"))


def q_pair_counts(spark, sf_dir):
    cells = P.contingency(_part(spark, sf_dir), "p_brand", "p_type")
    return P.pair_counts(cells).select("n", *(F.col(c).cast("bigint").alias(c) for c in ("both", "in_a", "in_b")))


def q_pair_counts_gs(spark, sf_dir):
    """Pair counts of three pairs of schemes in one pass."""
    part = _part(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(f"{x}/{y}").alias("pair"), F.col(x).cast("string").alias("x"), F.col(y).cast("string").alias("y")) for x, y in PAIRS))
    cells = P.contingency(part.select(F.explode(each).alias("s")).select("s.*"), "x", "y", ["pair"])
    return P.pair_counts(cells, ["pair"]).select("pair", "n", *(F.col(c).cast("bigint").alias(c) for c in ("both", "in_a", "in_b")))


def q_simpson(spark, sf_dir):
    return P.simpson(_part(spark, sf_dir), "p_brand")


def _one(name):
    return lambda spark, sf_dir: P.agreement(_part(spark, sf_dir), "p_brand", "p_type").select(name, "n")


q_wallace, q_adj_wallace, q_ari = _one("wallace"), _one("adj_wallace"), _one("ari")


def q_ami(spark, sf_dir):
    return P.adjusted_mutual_information(_part(spark, sf_dir), "p_brand", "p_type")


SCHEMES = ["p_brand", "p_type", "p_band"]
PAIRS = [("p_brand", "p_type"), ("p_brand", "p_band"), ("p_type", "p_band")]


def common_set(df: DataFrame, schemes: list[str]) -> DataFrame:
    """Rows that have every scheme's label: all values of a panel share them."""
    return df.dropna(subset=schemes)


def q_panel_simpson(spark, sf_dir):
    rows = common_set(_part(spark, sf_dir), SCHEMES).select(*(F.col(c).cast("string").alias(c) for c in SCHEMES))
    return P.simpson(rows.unpivot([], SCHEMES, "scheme", "label"), "label", ["scheme"])


def q_pairwise_ari(spark, sf_dir):
    rows = common_set(_part(spark, sf_dir), SCHEMES).select(*(F.col(c).cast("string").alias(c) for c in SCHEMES))
    two = [(x, y) for i, x in enumerate(SCHEMES) for y in SCHEMES[i + 1 :]]
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(f"{x}/{y}").alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in two))).alias("s")).select("s.*")
    return P.agreement(pairs, "x", "y", ["pair"])


def q_panel_pairwise(spark, sf_dir):
    """Each pair of schemes with intervals and mutual information, and the finest scheme to the others."""
    rows = common_set(_part(spark, sf_dir), SCHEMES)
    return P.agreement_panel(rows, PAIRS)


def _with_complexes(spark, sf_dir):
    """Rows with their type under two schemes, and the complex of linked types under each."""
    part = _part(spark, sf_dir).withColumns({"maker": F.substring("p_brand", 7, 1), "model": F.substring("p_brand", 8, 1), "type_a": F.concat_ws("|", "p_brand", "p_type"), "type_b": F.concat_ws("|", "p_type", F.col("p_size").cast("string"))})
    for scheme, loci in (("a", ["maker", "model", "p_type"]), ("b", ["p_type", "p_size"])):
        types = part.groupBy(f"type_{scheme}").agg(*(F.min(c).alias(c) for c in loci))
        found = D.complexes(types, f"type_{scheme}", loci).withColumn(f"complex_{scheme}", prefixed("CC", "complex")).drop("complex")
        part = part.join(found, f"type_{scheme}", "left")
    return handed_over(part, "typed-rows")  # the panels read it several times


def q_panel_cluster(spark, sf_dir):
    """Types and complexes of two schemes against the size band as the reference clustering, with intervals."""
    rows = _with_complexes(spark, sf_dir).dropna(subset=["p_band"])
    return P.agreement_panel(rows, [(c, "p_band") for c in ("type_a", "type_b", "complex_a", "complex_b")])


def q_wilson(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") >= 500).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = P.wilson(F.col("k"), F.col("n"))
    return docs.select("lang", "k", "n", lo.alias("lo"), hi.alias("hi"))


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def q_confusion(spark, sf_dir):
    return P.confusion(_labelled(spark, sf_dir), F.col("n_chars") >= 500, F.col("quality") == 1, ["lang"])


def q_mode(spark, sf_dir):
    """Commonest label of each source, the least of those that tie."""
    return _labelled(spark, sf_dir).groupBy("source").agg(F.mode("lang", True).alias("mode"), F.count(F.lit(1)).alias("n"))


def q_panel_classifier(spark, sf_dir):
    """One type and its complex, under two schemes, as predictors of the largest size band."""
    rows = _with_complexes(spark, sf_dir)
    top = lambda c: P.modal(rows, F.col("p_band") == 4, c).withColumnRenamed(c, f"top_{c}")
    typed = rows.crossJoin(F.broadcast(top("type_a"))).crossJoin(F.broadcast(top("type_b")))  # one row each
    for scheme in "ab":
        own = P.modal(typed, F.col(f"type_{scheme}") == F.col(f"top_type_{scheme}"), f"complex_{scheme}").withColumnRenamed(f"complex_{scheme}", f"top_complex_{scheme}")
        typed = typed.crossJoin(F.broadcast(own))
    names = ["type_a", "complex_a", "type_b", "complex_b"]
    return P.classifier_panel(typed, {n: F.col(n) == F.col(f"top_{n}") for n in names}, F.col("p_band") == 4)


def q_allele_classifier(spark, sf_dir):
    """Types that share the first type's value at one locus, as predictor of the smallest size band."""
    part = _part(spark, sf_dir)
    types = part.groupBy("p_type", "p_band").agg(F.min("p_partkey").alias("first"), F.min("p_size").alias("allele"))
    anchor = types.agg(F.min_by("allele", "first").alias("value"))
    alike = types.join(F.broadcast(anchor), F.col("allele") == F.col("value"), "left_semi").select("p_type", "p_band", F.lit(True).alias("hit"))
    return P.confusion(part.join(alike, ["p_type", "p_band"], "left"), F.coalesce("hit", F.lit(False)), F.col("p_band") == 0)


def q_boot_ci(spark, sf_dir):
    """1,000 replicates of the agreement of two partitions of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.when(F.get("embedding", 0) > 0, 1).otherwise(0).alias("sign"))
    return P.bootstrap(rows, "label", "sign", 1000)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_C = "c AS (SELECT p_brand a, p_type b, count(*) n FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL)"
_S = f"""{_C}, s AS (SELECT (SELECT sum(n*(n-1)//2) FROM c)::bigint s11, (SELECT sum(n*(n-1)//2) FROM (SELECT sum(n)::bigint n FROM c GROUP BY a))::bigint sa,
  (SELECT sum(n*(n-1)//2) FROM (SELECT sum(n)::bigint n FROM c GROUP BY b))::bigint sb, (SELECT sum(n) FROM c)::bigint n)"""
_LONG_AGREE = """c AS (SELECT k, a, b, count(*) n FROM l GROUP BY ALL),
s AS (SELECT k, s11, sa, sb, n FROM (SELECT k, sum(n*(n-1)//2)::double s11, sum(n)::bigint n FROM c GROUP BY k)
  JOIN (SELECT k, sum(n*(n-1)//2)::double sa FROM (SELECT k, a, sum(n)::bigint n FROM c GROUP BY k, a) GROUP BY k) USING (k)
  JOIN (SELECT k, sum(n*(n-1)//2)::double sb FROM (SELECT k, b, sum(n)::bigint n FROM c GROUP BY k, b) GROUP BY k) USING (k)),
t AS (SELECT *, n*(n-1)/2.0::double np FROM s)"""
_AGREE_COLS = """round(s11/sa, 8) AS wallace, round((s11/sa - sb/np)/(1 - sb/np), 8) AS adj_wallace, round((s11 - sa*sb/np)/((sa+sb)/2 - sa*sb/np), 8) AS ari, n"""
_SIMPSON = """s AS (SELECT k, sum(c)::bigint n, count(*) types, sum(c*(c-1)//2)::double alike, sum(c::double*c) s2, sum(c::double*c*c) s3 FROM cnt GROUP BY k),
d AS (SELECT *, 1 - alike/(n*(n-1)/2.0::double) AS d, sqrt(greatest(4.0/n*(s3/(n::double*n*n) - pow(s2/(n::double*n), 2)), 0)) AS se FROM s)"""
_SIMPSON_COLS = "round(d, 8) AS simpson, round(greatest(0, d-1.96*se), 8) AS lo, round(least(1, d+1.96*se), 8) AS hi, types, n"
_CONF = """w AS (SELECT *, tp::double/nullif(tp+fn,0) p1, (tp+fn)::double n1, tn::double/nullif(tn+fp,0) p2, (tn+fp)::double n2 FROM f),
x AS (SELECT *, (p1+1.96*1.96/(2*n1))/(1+1.96*1.96/n1) m1, 1.96*sqrt(p1*(1-p1)/n1+1.96*1.96/(4*n1*n1))/(1+1.96*1.96/n1) h1,
 (p2+1.96*1.96/(2*n2))/(1+1.96*1.96/n2) m2, 1.96*sqrt(p2*(1-p2)/n2+1.96*1.96/(4*n2*n2))/(1+1.96*1.96/n2) h2 FROM w)"""
_CONF_COLS = """tp, fp, fn, tn, round(p1, 8) AS sens, CASE WHEN p1 IS NOT NULL THEN round(greatest(0, m1-h1), 8) END AS sens_lo, CASE WHEN p1 IS NOT NULL THEN round(least(1, m1+h1), 8) END AS sens_hi,
 round(p2, 8) AS spec, CASE WHEN p2 IS NOT NULL THEN round(greatest(0, m2-h2), 8) END AS spec_lo, CASE WHEN p2 IS NOT NULL THEN round(least(1, m2+h2), 8) END AS spec_hi, round(tp::double/nullif(tp+fp,0), 8) AS ppv"""
_LEVELS = 11  # of the tree over cells; 2,048 cells of a pair at most in this SQL


def _mixed(rows: str, out: str, of: str) -> str:
    """``rows`` with a column that mixes the 32-bit integer ``of``, a step in each subquery."""
    step = lambda x, shift, by: f"((xor({x}, {x} >> {shift})) * {by}) & 4294967295"
    return f"SELECT * EXCLUDE (y), xor(y, y >> 15) AS {out} FROM (SELECT * REPLACE ({step('y', 15, 1935289751)} AS y) FROM (SELECT *, {step(f'({of})', 16, 569420461)} AS y FROM ({rows})))"


def uniform_sql(rows: str, seed: int = 0) -> str:
    """Rows (rep, v) with the number u in (0, 1) that mixes both, and a seed."""
    mixed = _mixed(_mixed(_mixed(_mixed(f"SELECT *, rep + 1 AS x FROM ({rows})", "e", "x"), "f", "xor(e, v & 4294967295)"), "hi", f"xor(f, {seed})"), "lo", f"xor(xor(f, {seed}), 1542469173)")
    return f"SELECT rep, v, (hi * 2097152.0::double + (lo >> 11) + 0.5::double) / 9007199254740992.0::double AS u FROM ({mixed})"


def _level(d: int) -> str:
    """Level d + 1 of the draws from level d: each node's draws are dealt to its halves by a binomial quantile."""
    return f"""s{d} AS MATERIALIZED (SELECT one, two, rep, v, d.t, depth, coalesce(lt.t, 0)::double / nt.t AS p, u
  FROM d{d} d JOIN nt USING (one, two, v) JOIN u USING (rep, v) LEFT JOIN nt lt ON lt.one = d.one AND lt.two = d.two AND lt.v = 2 * d.v WHERE d.v < (1::bigint << depth)),
j{d} AS (SELECT one, two, rep, v, t, p, u, low, unnest(range(low, high + 1)) AS j FROM (SELECT *, greatest(floor(t * p - 10 * sqrt(t * p * (1 - p)) - 10), 0)::bigint AS low, least(t, ceil(t * p + 10 * sqrt(t * p * (1 - p)) + 10))::bigint AS high FROM s{d} WHERE p > 0 AND p < 1)),
q{d} AS (SELECT one, two, rep, v, least(low + count(*) FILTER (upto < u), t) AS k FROM (SELECT *, sum(exp(lgamma(t + 1) - lgamma(j + 1) - lgamma(t - j + 1) + j * ln(p) + (t - j) * ln(1 - p))) OVER (PARTITION BY one, two, rep, v ORDER BY j) AS upto FROM j{d}) GROUP BY one, two, rep, v, low, t),
k{d} AS MATERIALIZED (SELECT s.*, CASE WHEN p >= 1 THEN s.t WHEN p <= 0 THEN 0 ELSE q.k END AS k FROM s{d} s LEFT JOIN q{d} q USING (one, two, rep, v)),
d{d + 1} AS MATERIALIZED (SELECT one, two, rep, 2 * v AS v, k AS t, depth FROM k{d} WHERE k > 0 UNION ALL SELECT one, two, rep, 2 * v + 1, t - k, depth FROM k{d} WHERE t > k UNION ALL SELECT * FROM d{d} WHERE v >= (1::bigint << depth)),
"""


def _statistics(cells: str, by: str, out: str) -> str:
    """{out} has the statistics of each group of a table of cells (by, a, b, n)."""
    return f"""{out}_a AS (SELECT {by}, a, sum(n)::bigint AS m FROM {cells} GROUP BY ALL), {out}_b AS (SELECT {by}, b, sum(n)::bigint AS m FROM {cells} GROUP BY ALL),
{out}_c AS (SELECT {by}, sum(n)::double AS n, sum(n::double * (n - 1) / 2) AS s11, sum(n * ln(n)) AS h0 FROM {cells} GROUP BY ALL),
{out}_am AS (SELECT {by}, m, count(*) AS k FROM {out}_a GROUP BY ALL), {out}_bm AS (SELECT {by}, m, count(*) AS k FROM {out}_b GROUP BY ALL),
{out}_as AS (SELECT {by}, sum(k * m::double * (m - 1) / 2) AS sa, sum(k * m * ln(m)) AS h1, sum(k) AS la FROM {out}_am GROUP BY ALL), {out}_bs AS (SELECT {by}, sum(k * m::double * (m - 1) / 2) AS sb, sum(k * m * ln(m)) AS h2, sum(k) AS lb FROM {out}_bm GROUP BY ALL),
{out}_k AS (SELECT {by}, x.m AS ra, y.m AS cb, x.k * y.k AS w, n::bigint AS tt, unnest(range(greatest(1, ra + cb - tt, floor(ra * cb / tt - 9 * sqrt(ra * cb / n * (1 - ra / n) * (1 - cb / n)) - 12)::bigint), least(ra, cb, ceil(ra * cb / n + 9 * sqrt(ra * cb / n * (1 - ra / n) * (1 - cb / n)) + 12)::bigint) + 1)) AS k
  FROM {out}_am x JOIN {out}_bm y USING ({by}) JOIN {out}_c USING ({by})),
{out}_e AS (SELECT {by}, sum(w * (k::double / tt) * ln(tt::double * k / (ra::double * cb)) * exp(lgamma(ra + 1) + lgamma(cb + 1) + lgamma(tt - ra + 1) + lgamma(tt - cb + 1) - lgamma(tt + 1) - lgamma(k + 1) - lgamma(ra - k + 1) - lgamma(cb - k + 1) - lgamma(tt - ra - cb + k + 1))) AS emi FROM {out}_k GROUP BY ALL),
{out}_t AS (SELECT *, n * (n - 1) / 2 AS np, sa * sb / (n * (n - 1) / 2) AS ex, ln(n) + (h0 - h1 - h2) / n AS mi, (2 * ln(n) - h1 / n - h2 / n) / 2 AS bound FROM {out}_c JOIN {out}_as USING ({by}) JOIN {out}_bs USING ({by}) JOIN {out}_e USING ({by})),
{out} AS (SELECT {by}, n::bigint AS n, CASE WHEN (sa + sb) / 2 = ex THEN 1 ELSE (s11 - ex) / ((sa + sb) / 2 - ex) END AS ari, CASE WHEN sa > 0 AND sb < np THEN (s11 / sa - sb / np) / (1 - sb / np) END AS adj_wallace,
  CASE WHEN la = 1 AND lb = 1 THEN 1 ELSE (mi - emi) / nullif(bound - emi, 0) END AS ami, 1 - sa / np AS simpson_one, 1 - sb / np AS simpson_two, la::bigint AS levels_one, lb::bigint AS levels_two FROM {out}_t)"""


_NAMES = ["ari", "adj_wallace", "ami", "simpson_one", "simpson_two"]
#: l has one, two, a, b: cells in the order of their labels, nodes of the tree above them, draws by level, statistics of each replicate.
_BOOT = f"""c AS (SELECT one, two, a, b, count(*) AS n FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY one, two ORDER BY a, b) - 1 AS cell FROM c), z AS (SELECT one, two, sum(n)::bigint AS t, CASE WHEN max(cell) > 0 THEN floor(log2(max(cell)))::bigint + 1 ELSE 0 END AS depth FROM o GROUP BY ALL),
nt AS MATERIALIZED (SELECT one, two, (1::bigint << d) + (cell >> (depth - d)) AS v, sum(n)::bigint AS t FROM o JOIN z USING (one, two), range({_LEVELS} + 1) r(d) WHERE d <= depth GROUP BY ALL),
u AS MATERIALIZED ({uniform_sql(f'SELECT rep::bigint AS rep, v::bigint AS v FROM range(1000) r(rep), range(1, {1 << _LEVELS}) n(v)')}),
d0 AS (SELECT one, two, rep, 1::bigint AS v, t, depth FROM z, range(1000) r(rep)),
{"".join(_level(d) for d in range(_LEVELS))}
x AS MATERIALIZED (SELECT d.one, d.two, rep, a, b, d.t AS n FROM d{_LEVELS} d JOIN o ON o.one = d.one AND o.two = d.two AND d.v = (1::bigint << depth) + cell),
{_statistics("x", "one, two, rep", "bs")},
ci AS (SELECT one, two, {", ".join(f"round(quantile_cont({c}, 0.025), 8) AS {c}_lo, round(quantile_cont({c}, 0.975), 8) AS {c}_hi, count({c}) AS n_{c}" for c in _NAMES)} FROM bs GROUP BY ALL)"""
_PANEL = f"""{_BOOT}, {_statistics("c", "one, two", "whole")}
SELECT one, two, levels_one, levels_two, {", ".join(f"round({c}, {6 if c == 'ami' else 8}) AS {c}, round({c}_lo, {6 if c == 'ami' else 8}) AS {c}_lo, round({c}_hi, {6 if c == 'ami' else 8}) AS {c}_hi" for c in _NAMES)}, n FROM whole JOIN ci USING (one, two)"""
_COMPLEXES = """RECURSIVE pa AS (SELECT p_partkey, p_type, p_size, p_size//10 AS p_band, p_brand || '|' || p_type AS type_a, p_type || '|' || p_size::varchar AS type_b, substr(p_brand, 7, 1) x, substr(p_brand, 8, 1) y FROM part),
na AS (SELECT DISTINCT type_a t, x, y, p_type z FROM pa), nb AS (SELECT DISTINCT type_b t, p_type x, p_size y FROM pa),
ea AS (SELECT p.t s, q.t FROM na p, na q WHERE p.t <> q.t AND (p.x = q.x)::int + (p.y = q.y)::int + (p.z = q.z)::int >= 2), eb AS (SELECT p.t s, q.t FROM nb p, nb q WHERE p.t <> q.t AND (p.x = q.x)::int + (p.y = q.y)::int >= 1),
wa AS (SELECT t s, t FROM na UNION SELECT wa.s, ea.t FROM wa JOIN ea ON ea.s = wa.t), wb AS (SELECT t s, t FROM nb UNION SELECT wb.s, eb.t FROM wb JOIN eb ON eb.s = wb.t),
ga AS (SELECT s type_a, 'CC' || dense_rank() OVER (ORDER BY c) AS complex_a FROM (SELECT s, min(t) c FROM wa GROUP BY s)), gb AS (SELECT s type_b, 'CC' || dense_rank() OVER (ORDER BY c) AS complex_b FROM (SELECT s, min(t) c FROM wb GROUP BY s)),
m AS (SELECT * FROM pa JOIN ga USING (type_a) JOIN gb USING (type_b))"""
_COUNTS = "count(*) FILTER (p AND t) tp, count(*) FILTER (p AND NOT t) fp, count(*) FILTER (NOT p AND t) fn, count(*) FILTER (NOT p AND NOT t) tn"
_LAB = "lab AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"

ORACLE_SQL = {
    "q_pair_counts": f'WITH {_S} SELECT s11 AS "both", sa AS in_a, sb AS in_b, n FROM s',
    "q_pair_counts_gs": f"""WITH r AS (SELECT p_brand, p_type, (p_size//10)::varchar AS p_band FROM part),
l AS (SELECT 'p_brand/p_type' k, p_brand a, p_type b FROM r UNION ALL SELECT 'p_brand/p_band', p_brand, p_band FROM r UNION ALL SELECT 'p_type/p_band', p_type, p_band FROM r),
{_LONG_AGREE} SELECT k AS pair, s11::bigint AS "both", sa::bigint AS in_a, sb::bigint AS in_b, n FROM t""",
    "q_wallace": f"WITH {_S} SELECT round(s11::double/sa, 8) AS wallace, n FROM s",
    "q_adj_wallace": f"WITH {_S}, t AS (SELECT *, n*(n-1)/2.0::double np FROM s) SELECT round((s11::double/sa - sb/np)/(1 - sb/np), 8) AS adj_wallace, n FROM t",
    "q_ari": f"WITH {_S}, t AS (SELECT *, n*(n-1)/2.0::double np FROM s) SELECT round((s11 - sa::double*sb/np)/((sa+sb)/2.0 - sa::double*sb/np), 8) AS ari, n FROM t",
    "q_simpson": f"WITH cnt AS (SELECT 1 k, p_brand, count(*) c FROM part WHERE p_brand IS NOT NULL GROUP BY ALL), {_SIMPSON} SELECT {_SIMPSON_COLS} FROM d",
    "q_panel_simpson": f"""WITH r AS (SELECT p_brand, p_type, p_size//10 AS p_band FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL),
cnt AS (SELECT 'p_brand' k, p_brand l, count(*) c FROM r GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'p_band', p_band::varchar, count(*) FROM r GROUP BY ALL),
{_SIMPSON} SELECT k AS scheme, {_SIMPSON_COLS} FROM d""",
    "q_pairwise_ari": f"""WITH r AS (SELECT p_brand, p_type, (p_size//10)::varchar AS p_band FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL),
l AS (SELECT 'p_brand/p_type' k, p_brand a, p_type b FROM r UNION ALL SELECT 'p_brand/p_band', p_brand, p_band FROM r UNION ALL SELECT 'p_type/p_band', p_type, p_band FROM r),
{_LONG_AGREE} SELECT k AS pair, {_AGREE_COLS} FROM t""",
    "q_panel_pairwise": f"""WITH l AS (SELECT 'p_brand' one, 'p_type' two, p_brand a, p_type b FROM part UNION ALL SELECT 'p_brand', 'p_band', p_brand, (p_size//10)::bigint::varchar FROM part
 UNION ALL SELECT 'p_type', 'p_band', p_type, (p_size//10)::bigint::varchar FROM part), {_PANEL}""",
    "q_panel_cluster": f"""WITH {_COMPLEXES}, l AS ({" UNION ALL ".join(f"SELECT '{c}' one, 'p_band' two, {c} a, p_band::bigint::varchar b FROM m" for c in ("type_a", "type_b", "complex_a", "complex_b"))}), {_PANEL}""",
    "q_ami": f"""WITH {_C}, ra AS (SELECT a, sum(n)::bigint ra FROM c GROUP BY a), cb AS (SELECT b, sum(n)::bigint cb FROM c GROUP BY b), tot AS (SELECT sum(n)::bigint tt FROM c),
mi AS (SELECT sum(n::double/tt*ln(n::double*tt/(ra::double*cb))) mi FROM c JOIN ra USING (a) JOIN cb USING (b), tot),
h AS (SELECT (SELECT -sum(ra::double/tt*ln(ra::double/tt)) FROM ra, tot) ha, (SELECT -sum(cb::double/tt*ln(cb::double/tt)) FROM cb, tot) hb),
k AS (SELECT ra, cb, tt, unnest(range(greatest(1, ra+cb-tt), least(ra, cb)+1)) k FROM ra, cb, tot),
e AS (SELECT sum(k::double/tt*ln(tt::double*k/(ra::double*cb))*exp(lgamma(ra+1)+lgamma(cb+1)+lgamma(tt-ra+1)+lgamma(tt-cb+1)-lgamma(tt+1)-lgamma(k+1)-lgamma(ra-k+1)-lgamma(cb-k+1)-lgamma(tt-ra-cb+k+1))) emi FROM k)
SELECT round((mi-emi)/((ha+hb)/2-emi), 6) AS ami, round(mi, 6) AS mi, round(emi, 6) AS expected, tt AS n FROM mi, h, e, tot""",
    "q_wilson": """WITH f AS (SELECT lang, count(*) FILTER (n_chars >= 500) k, count(*) n FROM documents GROUP BY lang), w AS (SELECT *, k::double/n p FROM f)
SELECT lang, k, n, round(greatest(0, (p+1.96*1.96/(2.0*n))/(1+1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0*n*n))/(1+1.96*1.96/n)), 8) AS lo,
round(least(1, (p+1.96*1.96/(2.0*n))/(1+1.96*1.96/n) + 1.96*sqrt(p*(1-p)/n+1.96*1.96/(4.0*n*n))/(1+1.96*1.96/n)), 8) AS hi FROM w""",
    "q_confusion": f"WITH {_LAB}, f AS (SELECT lang, {_COUNTS} FROM (SELECT lang, n_chars >= 500 p, quality = 1 t FROM lab) WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY lang), {_CONF} SELECT lang, {_CONF_COLS} FROM x",
    "q_mode": f"""WITH {_LAB}, c AS (SELECT source, lang, count(*) k FROM lab GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC, lang) i, sum(k) OVER (PARTITION BY source) n FROM c)
SELECT source, lang AS mode, n::bigint AS n FROM r WHERE i = 1""",
    "q_panel_classifier": f"""WITH {_COMPLEXES}, ta AS (SELECT type_a v FROM m WHERE p_band = 4 GROUP BY type_a ORDER BY count(*) DESC, type_a LIMIT 1), tb AS (SELECT type_b v FROM m WHERE p_band = 4 GROUP BY type_b ORDER BY count(*) DESC, type_b LIMIT 1),
ca AS (SELECT complex_a v FROM m WHERE type_a = (SELECT v FROM ta) GROUP BY complex_a ORDER BY count(*) DESC, complex_a LIMIT 1), cb AS (SELECT complex_b v FROM m WHERE type_b = (SELECT v FROM tb) GROUP BY complex_b ORDER BY count(*) DESC, complex_b LIMIT 1),
l AS (SELECT 'type_a' predictor, type_a = (SELECT v FROM ta) p, p_band = 4 t FROM m UNION ALL SELECT 'complex_a', complex_a = (SELECT v FROM ca), p_band = 4 FROM m
 UNION ALL SELECT 'type_b', type_b = (SELECT v FROM tb), p_band = 4 FROM m UNION ALL SELECT 'complex_b', complex_b = (SELECT v FROM cb), p_band = 4 FROM m),
f AS (SELECT predictor, {_COUNTS} FROM l WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY predictor), {_CONF} SELECT predictor, {_CONF_COLS} FROM x""",
    "q_allele_classifier": f"""WITH ty AS (SELECT p_type, p_size//10 band, min(p_partkey) f, min(p_size) allele FROM part GROUP BY ALL), h AS (SELECT p_type, band FROM ty WHERE allele = (SELECT allele FROM ty ORDER BY f LIMIT 1)),
l AS (SELECT ((p_type, p_size//10) IN (SELECT (p_type, band) FROM h)) AS p, p_size//10 = 0 AS t FROM part), f AS (SELECT {_COUNTS} FROM l WHERE p IS NOT NULL AND t IS NOT NULL), {_CONF} SELECT {_CONF_COLS} FROM x""",
    "q_boot_ci": f"""WITH l AS (SELECT 'x' one, 'x' two, label a, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END b FROM embeddings), {_BOOT}
{" UNION ALL ".join(f"SELECT '{c}' AS statistic, {c}_lo AS lo, {c}_hi AS hi, n_{c} AS n FROM ci" for c in _NAMES)}""",
}
