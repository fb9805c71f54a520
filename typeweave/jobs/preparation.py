"""Queries on sequence and table preparation, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeweave.operators import encode, seq
from typeweave.sources.tables import table

RANGES = [(0, 40), (40, 85), (85, 120), (120, 160), (160, 205), (205, 240)]


def _docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def q_id_class(spark, sf_dir):
    """Pages by the class of their host's first label and the stem of their file name."""
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    kind = F.when(host.rlike(r"^(www|m)\."), "site").when(host.rlike(r"^blog\."), "blog").when(host.startswith("spam"), "junk").otherwise("other")
    stem = F.regexp_extract(F.substring_index(F.regexp_extract("url", r"^[^?#]*", 0), "/", -1), r"^([^.]*)", 1)
    return table(spark, sf_dir, "pages").select(kind.alias("kind"), (stem != "").alias("named")).groupBy("kind", "named").agg(F.count(F.lit(1)).alias("n"))


def q_normalize(spark, sf_dir):
    clean = seq.ascii_upper(seq.trimmed(F.col("text")))
    return _docs(spark, sf_dir, "lang", "text").groupBy("lang").agg(
        F.count_distinct(F.md5(clean)).alias("texts"), F.count_distinct(F.length(clean)).alias("lengths"), F.sum(F.length(clean)).alias("chars")
    )


def q_na_literal(spark, sf_dir):
    """Documents by label, where the literal NA is a value and a missing label is none."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("NA").alias("label"))
    joined = _docs(spark, sf_dir).join(labels, "doc_id", "left")
    return joined.agg(F.count_if(F.col("label") == "NA").alias("literal_na"), F.count_if(F.col("label").isNull()).alias("missing"), F.count_if(F.col("label") != "NA").alias("kept"))


def q_try_cast(spark, sf_dir):
    value = F.get_json_object("props", "$.k")
    number = value.try_cast("int")
    bad = F.substring("event_type", 1, 3).try_cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(number).alias("numbers"), F.sum(number).alias("total"), F.count(bad).alias("coerced"))


def q_assembly_qc(spark, sf_dir):
    return seq.quality(_docs(spark, sf_dir, "source", "text").where("text IS NOT NULL"), "source", "text", 100_000, 100_000_000, 2_000)


def q_n50(spark, sf_dir):
    return seq.n50(_docs(spark, sf_dir, "lang", "n_chars"), "lang", "n_chars")


def q_best_hit(spark, sf_dir):
    """Each order's line of highest price whose quantity is near the part's size."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_partkey").alias("p_partkey"))
    hits = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    best = seq.best_hit(hits, "l_orderkey", F.col("l_quantity"), F.col("p_size").cast("double"), "l_extendedprice", "l_linenumber")
    return best.select("l_orderkey", "l_linenumber", "p_partkey", F.round("l_extendedprice", 2).alias("score"))


def q_revcomp_slice(spark, sf_dir):
    start, end = (F.col("doc_id") % 50 + 1).cast("int"), (F.col("doc_id") * 7 % 60 + 1).cast("int")
    return _docs(spark, sf_dir, "text").select("doc_id", seq.slice_with_strand(seq.ascii_upper(F.col("text")), start, end).alias("part"))


def q_substr_loci(spark, sf_dir):
    parts = [F.struct(F.lit(k).alias("locus"), F.substring("text", a + 1, b - a).alias("part")) for k, (a, b) in enumerate(RANGES)]
    rows = _docs(spark, sf_dir, "text").select(F.explode(F.array(*parts)).alias("p")).select("p.*").where("part <> ''")
    return rows.groupBy("locus").agg(F.count_distinct("part").alias("alleles"), F.count(F.lit(1)).alias("n"))


def q_concat_partition(spark, sf_dir):
    """Where each language's longest text would stand if they were joined, and the digest of each conversation's joined turns."""
    blocks = _docs(spark, sf_dir, "lang", "n_chars").groupBy("lang").agg(F.max("n_chars").alias("length"))
    placed = seq.partitions(blocks, "lang", "length").select(F.col("lang").alias("name"), F.col("first").alias("a"), F.col("last").alias("b"), F.lit("").alias("digest"))
    joined = seq.concatenated(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    rows = joined.select(F.col("conv_id").cast("string").alias("name"), F.lit(1).cast("bigint").alias("a"), F.length("seq").cast("bigint").alias("b"), F.md5("seq").alias("digest"))
    return placed.unionByName(rows)


def q_pis(spark, sf_dir):
    """Sites of all texts, over their whole lengths."""
    return seq.informative_sites(_docs(spark, sf_dir, "text"), "text")


def q_pad(spark, sf_dir):
    """Each source's blocks by language, joined; a language that a source lacks is filled with N."""
    digest = F.md5(F.min(F.concat_ws("|", "doc_id", "text")))
    rows = _docs(spark, sf_dir, "source", "lang", "text")
    blocks = rows.groupBy("source", "lang").agg(digest.alias("block"), F.count(F.lit(1)).alias("n")).where("n % 3 <> 0").select("source", "lang", "block")
    lengths = rows.select("lang").distinct().select("lang", F.lit(32).alias("length"))
    return seq.concatenated(blocks, "source", "lang", "block", lengths)


def q_last_match(spark, sf_dir):
    """The last turn of each conversation whose text has a comma."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return seq.last_matching(turns, "conv_id", "turn", "text", ",").select("conv_id", F.md5("text").alias("digest"))


def q_profile_labels(spark, sf_dir):
    """Suppliers joined to their nation's label; for each label the first balance by key that isn't negative."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").join(nation, "s_nationkey")
    known = F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey"))
    return rows.groupBy("n_name").agg(F.round(F.min_by("s_acctbal", known), 2).alias("first_balance"), F.count(F.lit(1)).alias("n"))


def q_inner_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled_id")
    docs = _docs(spark, sf_dir, "lang")
    return docs.join(labels, F.col("doc_id") == F.col("labelled_id")).groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


def q_left_master(spark, sf_dir):
    """Customers with their nation and the number of their orders, always joined by key."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey", "left").join(orders, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"))


def q_semi_flag(spark, sf_dir):
    """Per source, documents that are labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(1))
    return _docs(spark, sf_dir, "source").join(good, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("good"))


def q_anti_pending(spark, sf_dir):
    """Documents still to be labelled, by source: the work list without what is done."""
    return _docs(spark, sf_dir, "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("pending"), F.min("doc_id").alias("first"))


def q_first_nonnull(spark, sf_dir):
    """Each customer's first urgent order, by key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")).alias("urgent"))
    return orders.groupBy("o_custkey").agg(F.min_by("urgent", F.when(F.col("urgent").isNotNull(), F.col("o_orderkey"))).alias("first_urgent"))


def _key_sets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").distinct(), table(spark, sf_dir, "labels").select("doc_id").distinct()


def q_set_ops(spark, sf_dir):
    """Sizes of the union, intersection, differences and symmetric difference of two key sets, from one full join."""
    a, b = _key_sets(spark, sf_dir)
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "doc_id", "full")
    x, y = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(F.count(F.lit(1)).alias("union"), F.count_if(x & y).alias("intersection"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x != y).alias("symmetric"))


def q_common_set(spark, sf_dir):
    """Entities that three schemes all cover, without the outgroup."""
    docs, labels = _key_sets(spark, sf_dir)
    long = _docs(spark, sf_dir, "n_chars").where("n_chars >= 500").select("doc_id")
    return docs.intersect(labels).intersect(long).where("doc_id <> 0").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("sum_id"))


def q_set_equal(spark, sf_dir):
    """Whether two rules pick the same parts, with the sizes."""
    part = table(spark, sf_dir, "part")
    rule = lambda c: part.where(c).select("p_partkey").distinct()
    a, b = rule("p_size <= 10"), rule("p_size < 11 AND p_partkey > 0")
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "p_partkey", "full")
    return both.agg(F.coalesce(F.bool_and(F.col("x").isNotNull() & F.col("y").isNotNull()), F.lit(True)).alias("equal"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count("x").alias("a"), F.count("y").alias("b"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_N50 = """c AS (SELECT k, len, count(*) m FROM p WHERE len IS NOT NULL GROUP BY ALL), t AS (SELECT k, sum(m*len)::bigint total, sum(m)::bigint pieces FROM c GROUP BY k),
u AS (SELECT k, len, sum(m*len) OVER (PARTITION BY k ORDER BY len DESC ROWS UNBOUNDED PRECEDING) upto FROM c),
n AS (SELECT k, total, pieces, max(len) n50 FROM u JOIN t USING (k) WHERE 2*upto >= total GROUP BY ALL)"""
ORACLE_SQL = {
    "q_id_class": r"""WITH h AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) h, regexp_extract(regexp_extract(regexp_extract(url, '^[^?#]*'), '([^/]*)$', 1), '^([^.]*)', 1) s FROM pages)
SELECT CASE WHEN regexp_matches(h, '^(www|m)\.') THEN 'site' WHEN regexp_matches(h, '^blog\.') THEN 'blog' WHEN starts_with(h, 'spam') THEN 'junk' ELSE 'other' END AS kind, s <> '' AS named, count(*) AS n FROM h GROUP BY ALL""",
    "q_normalize": f"""WITH c AS (SELECT lang, {_UP.format("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")} t FROM documents)
SELECT lang, count(DISTINCT md5(t)) AS texts, count(DISTINCT length(t)) AS lengths, sum(length(t))::bigint AS chars FROM c GROUP BY lang""",
    "q_na_literal": """WITH j AS (SELECT CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'good' ELSE 'NA' END label FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) FILTER (label = 'NA') AS literal_na, count(*) FILTER (label IS NULL) AS missing, count(*) FILTER (label <> 'NA') AS kept FROM j""",
    "q_try_cast": "SELECT event_type, count(try_cast(json_extract_string(props, '$.k') AS int)) AS numbers, sum(try_cast(json_extract_string(props, '$.k') AS int))::bigint AS total, count(try_cast(substr(event_type, 1, 3) AS int)) AS coerced FROM events GROUP BY event_type",
    "q_assembly_qc": f"""WITH p AS (SELECT source k, length(text) len, length(regexp_replace({_UP.format('text')}, '[^GC]', '', 'g')) gc FROM documents WHERE text IS NOT NULL), {_N50}, g AS (SELECT k, sum(gc) gc FROM p GROUP BY k)
SELECT k AS source, total AS total_bp, pieces AS contigs, n50, round(CASE WHEN total > 0 THEN 100.0::double*gc/total ELSE 0 END, 6) AS gc_pct, CASE WHEN total BETWEEN 100000 AND 100000000 AND n50 >= 2000 THEN 'PASS' ELSE 'FAIL' END AS status FROM n JOIN g USING (k)""",
    "q_n50": f"WITH p AS (SELECT lang k, n_chars len FROM documents), {_N50} SELECT k AS lang, total, pieces, n50 FROM n",
    "q_best_hit": """SELECT l_orderkey, l_linenumber, p_partkey, round(l_extendedprice, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) i
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity BETWEEN 0.5*p_size AND 1.5*p_size AND l_extendedprice > 0) WHERE i = 1""",
    "q_revcomp_slice": f"""WITH s AS (SELECT doc_id, {_UP.format('text')} t, doc_id % 50 + 1 a, doc_id*7 % 60 + 1 b FROM documents)
SELECT doc_id, CASE WHEN a <= b THEN substr(t, a, b-a+1) ELSE translate(reverse(substr(t, b, a-b+1)), 'ACGTacgt', 'TGCAtgca') END AS part FROM s""",
    "q_substr_loci": "WITH r AS (SELECT unnest(range(6))::int locus, unnest([substr(text,1,40), substr(text,41,45), substr(text,86,35), substr(text,121,40), substr(text,161,45), substr(text,206,35)]) part FROM documents) SELECT locus, count(DISTINCT part) AS alleles, count(*) AS n FROM r WHERE part <> '' GROUP BY locus",
    "q_concat_partition": """WITH b AS (SELECT lang, max(n_chars) len FROM documents GROUP BY lang)
SELECT lang AS name, (sum(len) OVER (ORDER BY lang) - len + 1)::bigint AS a, (sum(len) OVER (ORDER BY lang))::bigint AS b, '' AS digest FROM b
UNION ALL SELECT conv_id::varchar, 1, length(s), md5(s) FROM (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) s FROM conversations GROUP BY conv_id)""",
    "q_pis": f"""WITH t AS (SELECT {_UP.format('text')} t FROM documents WHERE text IS NOT NULL), c AS (SELECT unnest(range(length(t)))::int site, unnest(string_split(t, '')) state FROM t),
n AS (SELECT site, state, count(*) n FROM c WHERE state <> '' GROUP BY ALL) SELECT site, count(*) AS states, count(*) FILTER (n >= 2) >= 2 AS informative FROM n GROUP BY site""",
    "q_pad": """WITH b AS (SELECT source, lang, md5(min(doc_id::varchar || '|' || text)) b, count(*) n FROM documents GROUP BY ALL),
h AS (SELECT source, lang, b FROM b WHERE n % 3 <> 0), g AS (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM h) s, (SELECT DISTINCT lang FROM documents) l)
SELECT source, string_agg(coalesce(b, repeat('N', 32)), '' ORDER BY lang) AS seq FROM g LEFT JOIN h USING (source, lang) GROUP BY source""",
    "q_last_match": "SELECT conv_id, md5(max_by(text, turn)) AS digest FROM conversations WHERE contains(text, ',') GROUP BY conv_id",
    "q_profile_labels": "SELECT n_name, round(min_by(s_acctbal, s_suppkey) FILTER (s_acctbal >= 0), 2) AS first_balance, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name",
    "q_inner_labels": "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "q_left_master": "SELECT c_custkey, n_name, count(o_orderkey) AS orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "q_semi_flag": "SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM documents GROUP BY source",
    "q_anti_pending": "SELECT source, count(*) AS pending, min(doc_id) AS first FROM documents ANTI JOIN labels USING (doc_id) GROUP BY source",
    "q_first_nonnull": "SELECT o_custkey, min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS first_urgent FROM orders GROUP BY o_custkey",
    "q_set_ops": """WITH j AS (SELECT a.doc_id x, b.doc_id y FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b USING (doc_id))
SELECT count(*) AS "union", count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS intersection, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) FILTER (x IS NULL OR y IS NULL) AS symmetric FROM j""",
    "q_common_set": "SELECT count(*) AS n, sum(doc_id)::bigint AS sum_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars >= 500) WHERE doc_id <> 0",
    "q_set_equal": "WITH a AS (SELECT p_partkey k FROM part WHERE p_size <= 10), b AS (SELECT p_partkey k FROM part WHERE p_size < 11 AND p_partkey > 0), j AS (SELECT a.k x, b.k y FROM a FULL JOIN b USING (k)) SELECT bool_and(x IS NOT NULL AND y IS NOT NULL) AS equal, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(x) AS a, count(y) AS b FROM j",
}
