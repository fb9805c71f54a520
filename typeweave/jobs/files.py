"""Queries that write tables as files, read these back and work on what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from typeweave.operators import distance as D
from typeweave.operators import seq
from typeweave.operators import tree as T
from typeweave.sources import delimited, fasta, newick, sequences, sinks, spreadsheet, table_functions, worklist
from typeweave.sources.tables import handed_over, shared_folder, table


def _folder(spark, what):
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def q_fasta(spark, sf_dir):
    """The letters of all documents as sequence files by language, in lines of 60, read back."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.regexp_replace(letters, "(.{60})", "$1\n").alias("seq"))
    path = _folder(spark, "fasta")
    sinks.fasta(docs, "doc_id", "seq", path, by="lang")
    found = fasta.by_first_word(fasta.records(spark, path, "*.txt"))
    return found.select(F.col("id").cast("bigint").alias("doc_id"), F.length("seq").alias("n"), F.md5("seq").alias("digest"))


def q_fasta_quality(spark, sf_dir):
    """Quality figures of the same, by source, from the files."""
    letters = F.regexp_replace("text", "[^A-Za-z]+", "")
    docs = table(spark, sf_dir, "documents").select("source", F.concat_ws(" ", "source", "doc_id").alias("id"), letters.alias("seq"))
    path = _folder(spark, "fasta")
    sinks.fasta(docs, "id", "seq", path)
    found = fasta.records(spark, path, "*.txt").select(F.get(F.split("header", " "), 0).alias("source"), "seq")
    return seq.quality(found, "source", "seq", 100_000, 100_000_000, 2_000)


def q_hit_table(spark, sf_dir):
    """Order lines as a hit table with short lines in between, read back; each order's best hit."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    fields = [F.col("l_orderkey"), F.lit(1.5), F.col("l_quantity").cast("int"), F.col("p_size"), F.col("l_linenumber"), F.col("l_linenumber"), F.lit("plus"), F.col("l_extendedprice")]
    text = F.when(F.col("l_linenumber") == 7, "too\tshort").otherwise(F.concat_ws("\t", *(f.cast("string") for f in fields)))
    path = _folder(spark, "hits")
    rows.select(text.alias("value")).write.text(path)
    best = seq.best_hit(delimited.hits(spark, path), "sseqid", F.col("length"), F.col("qlen").cast("double"), "bitscore", "sstart")
    return best.select(F.col("sseqid").cast("bigint").alias("l_orderkey"), F.col("sstart").alias("line"), F.round("bitscore", 2).alias("score"))


def q_csv_missing(spark, sf_dir):
    """Labels of all documents as a CSV in which NA is written and an empty cell is left: what three readings take for missing."""
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "NA").otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", label.alias("label"))
    path = _folder(spark, "csv")
    rows.write.csv(path, header=True, emptyValue="")
    counts = [
        delimited.csv(spark, path, missing).agg(F.lit(missing).alias("reading"), F.count_if(F.col("label").isNull()).alias("missing"), F.count_if(F.col("label") == "NA").alias("literal_na"), F.count(F.lit(1)).alias("n"))
        for missing in ("usual", "empty", "never")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def q_flagged(spark, sf_dir):
    """Customers' types as a CSV of records; those without missing data, by the flag and, in a table without it, by the label."""
    from typeweave.jobs.encoding import q_st_assign

    path = _folder(spark, "records")
    sinks.records(q_st_assign(spark, sf_dir), path)
    read = delimited.csv(spark, path, "never")
    one = delimited.without_missing_data(read, label="st").agg(F.lit("flag").alias("by"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_novel") == "yes").alias("novel"))
    two = delimited.without_missing_data(read.drop("has_missing_data"), label="st").agg(F.lit("label").alias("by"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_novel") == "yes").alias("novel"))
    return one.unionByName(two)


def q_wide_export(spark, sf_dir):
    """Vectors as an export of one column a target, with headers of two lines; distances to the first from what was read."""
    cells = [F.when(F.floor(F.get("embedding", k) * 4) != 0, F.floor(F.get("embedding", k) * 4).cast("string")).otherwise("?").alias(f"t{k}\n(core)") for k in range(64)]
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("Sample ID\nof the export"), F.col("label").alias("Perc. of\n(core)"), *cells)
    path = _folder(spark, "export")
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    read = delimited.wide_export(spark, path, ["Sample ID"], "(core)", ("Perc.", "Complex")).select(F.col("Sample ID").cast("bigint").alias("vec_id"), "profile")
    anchor = read.agg(F.min_by("profile", "vec_id").alias("profile"))
    return D.distance_to_anchor(read, anchor, "vec_id", "profile", 40)


def q_spreadsheet(spark, sf_dir):
    """All orders as workbooks, with missing cells and texts that XML has to escape, read back."""
    odd = F.concat(F.lit(" <"), "o_orderstatus", F.lit("&_x0041_\a\r\n>"), "o_orderpriority", F.lit(" "))
    label = F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 5 == 1, "NA").when(F.col("o_orderkey") % 5 == 2, "").otherwise(odd)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("Label\n(of the order)"), (F.col("o_totalprice") > 100_000).alias("large"), F.col("o_totalprice").cast("double").alias("price"))
    folder = _folder(spark, "books")
    spreadsheet.spreadsheets(orders, ["o_orderkey"], folder)
    read = spreadsheet.sheet(spark, folder, "usual")
    text = F.col("Label\n(of the order)")
    return read.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.md5(text).alias("digest"), (F.col("large") == "1").alias("large"), F.round(F.col("price").cast("double"), 2).alias("price"))


def q_newick(spark, sf_dir):
    """Suppliers of each nation as a tree in Newick form, read back: leaves, inner nodes, total length and median support."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.floor((F.col("s_acctbal") + 1000) / 2500).cast("int").alias("band"))
    leaf = F.concat(F.lit("'S "), F.col("s_suppkey").cast("string"), F.lit("':"), (0.5 + F.col("s_suppkey") % 4 * 0.25).cast("string"))
    bands = s.groupBy("s_nationkey", "band").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(leaf)), ","), F.lit(")"), (F.col("band") * 10 + 50).cast("string"), F.lit(":1.5")).alias("clade"))
    trees = bands.groupBy(F.col("s_nationkey").cast("string").alias("tree")).agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list("clade")), ","), F.lit(");")).alias("newick"))
    nodes = newick.nodes_of(trees)
    return nodes.groupBy("tree").agg(F.count_if("is_leaf").alias("leaves"), F.count_if(~F.col("is_leaf")).alias("inner"), F.round(F.sum("length"), 6).alias("length")).join(T.support(nodes).select("tree", "median"), "tree")


def q_work_list(spark, sf_dir):
    """Orders as a work list done in three runs, the second of them killed before its commit and one run twice: every order once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    folder = _folder(spark, "work")
    worklist.append_once(orders.where("o_orderkey % 3 = 0"), folder, "first")
    orders.where("o_orderkey % 3 = 1").write.parquet(f"{folder}/parts/killed")
    worklist.append_once(orders, folder, "first")
    worklist.append_once(worklist.pending(orders, folder, "o_orderkey", orders.schema), folder, "rest")
    left = worklist.pending(orders, folder, "o_orderkey", orders.schema).agg(F.count(F.lit(1)).alias("pending"))
    done = worklist.appended(spark, folder, orders.schema).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"))
    return done.crossJoin(F.broadcast(left))  # one row


def q_newick_rows(spark, sf_dir):
    """Nodes of each nation's suppliers as a tree, from SQL: a row for each node as it is closed."""
    table_functions.registered(spark)
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.floor((F.col("s_acctbal") + 1000) / 2500).cast("int").alias("band"))
    leaf = F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.lit(":"), (0.5 + F.col("s_suppkey") % 4 * 0.25).cast("string"))
    bands = s.groupBy("s_nationkey", "band").agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(leaf)), ","), F.lit(")"), (F.col("band") * 10 + 50).cast("string")).alias("clade"))
    trees = bands.groupBy("s_nationkey").agg(F.concat(F.lit("("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", "clade"))), lambda x: x["clade"]), ","), F.lit(");")).alias("newick"))
    return spark.sql("SELECT t.s_nationkey, n.name, n.confidence, n.length, n.first, n.last - n.first + 1 AS size, n.depth FROM {trees} t, LATERAL newick_nodes(t.newick) n", trees=trees)


def q_locus_rows(spark, sf_dir):
    """Six ranges of each document as loci, from SQL; a range that a text doesn't fill is missing."""
    table_functions.registered(spark)
    loci = ", ".join(f"named_struct('locus', 'l{k}', 'first', {a}, 'last', {b})" for k, (a, b) in enumerate(((1, 40), (41, 85), (86, 120), (121, 900), (901, 4000), (4001, 4450))))
    return spark.sql(f"SELECT d.doc_id, l.locus, l.length, md5(l.seq) AS digest FROM {{docs}} d, LATERAL locus_rows(d.text, array({loci})) l", docs=table(spark, sf_dir, "documents"))


def q_hit_ranges(spark, sf_dir):
    """Every order line as a hit on the document of its part's number: its range, backwards for every third line, from the chunks that it touches."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    # Texts are dealt out by their number only where several share it.
    repeated = handed_over(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    docs = rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    low = (F.col("l_suppkey") * 131 + F.col("l_orderkey") * 17) % 9000 + 1
    high = low + (F.col("l_extendedprice") % 6000).cast("bigint")
    hits = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("contig"), low.alias("low"), high.alias("high"))
    turned = F.col("l_linenumber") % 3 == 0
    hits = hits.select("l_orderkey", "l_linenumber", "contig", F.when(turned, F.col("high")).otherwise(F.col("low")).alias("start"), F.when(turned, F.col("low")).otherwise(F.col("high")).alias("end"))
    found = sequences.ranges(sequences.store(docs, "doc_id", "text"), hits, "contig", "start", "end")
    return found.where("part IS NOT NULL").select("l_orderkey", F.col("l_linenumber").alias("line"), "contig", F.length("part").alias("n"), F.md5("part").alias("digest"))


def q_partition_file(spark, sf_dir):
    """Languages as loci of their longest text, as one partition file, read back line by line."""
    blocks = table(spark, sf_dir, "documents").groupBy("lang").agg(F.max("n_chars").alias("length"))
    path = f"{_folder(spark, 'partitions')}.txt"
    sinks.partition_file(seq.partitions(blocks, "lang", "length"), "lang", path)
    whole = spark.read.text(path, wholetext=True)  # a line a locus
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("k", "line"))


def q_joined_fasta(spark, sf_dir):
    """Conversations' turns joined in one file that is named with their number, read back by header."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.translate(seq.ascii_upper(F.coalesce("text", F.lit(""))), "> \n\r\t", "").alias("text"))
    joined = seq.concatenated(turns, "conv_id", "turn", "text").where("seq <> ''")
    path = sinks.concatenated_fasta(joined, "conv_id", "seq", _folder(spark, "joined"), "turns")
    found = fasta.by_header(fasta.records(spark, path.rpartition("/")[0], "concat_turns_*.fasta"))
    return found.select(F.col("id").cast("bigint").alias("conv_id"), F.regexp_extract("stem", r"_(\d+)$", 1).cast("bigint").alias("named"), F.length("seq").alias("n"), F.md5("seq").alias("digest"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

from typeweave.jobs.encoding import ORACLE_SQL as _ENCODING  # noqa: E402
from typeweave.jobs.linkage import _D  # noqa: E402
from typeweave.jobs.preparation import _N50  # noqa: E402

_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
ORACLE_SQL = {
    "q_fasta": f"SELECT doc_id, length(s)::int AS n, md5(s) AS digest FROM (SELECT doc_id, {_LETTERS} s FROM documents) WHERE s <> ''",
    "q_fasta_quality": f"""WITH d AS (SELECT source k, {_LETTERS} s FROM documents), p AS (SELECT k, length(s) len, length(regexp_replace(s, '[^GC]', '', 'g')) gc FROM d WHERE s <> ''), {_N50}, g AS (SELECT k, sum(gc) gc FROM p GROUP BY k)
SELECT k AS source, total AS total_bp, pieces AS contigs, n50, round(CASE WHEN total > 0 THEN 100.0::double*gc/total ELSE 0 END, 6) AS gc_pct, CASE WHEN total BETWEEN 100000 AND 100000000 AND n50 >= 2000 THEN 'PASS' ELSE 'FAIL' END AS status FROM n JOIN g USING (k)""",
    "q_hit_table": """SELECT l_orderkey, l_linenumber AS line, round(l_extendedprice, 2) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) i
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 7 AND floor(l_quantity) BETWEEN 0.5*p_size AND 1.5*p_size AND l_extendedprice > 0) WHERE i = 1""",
    "q_csv_missing": """WITH j AS (SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'NA' ELSE '' END l FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (l = '') e, count(*) FILTER (l = 'NA') a, count(*) n FROM j)
SELECT 'usual' AS reading, e + a AS missing, 0 AS literal_na, n FROM c UNION ALL SELECT 'empty', e, a, n FROM c UNION ALL SELECT 'never', 0, a, n FROM c""",
    "q_flagged": f"WITH t AS ({_ENCODING['q_st_assign']}), c AS (SELECT count(*) FILTER (NOT has_missing_data) n, count(*) FILTER (is_novel) k FROM t) SELECT 'flag' AS \"by\", n, k AS novel FROM c UNION ALL SELECT 'label', n, k FROM c",
    "q_wide_export": f"WITH {_D} SELECT vec_id, distance, compared, distance <= 40 AS member FROM d",
    "q_spreadsheet": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 THEN md5(' <' || o_orderstatus || '&_x0041_' || chr(7) || chr(13) || chr(10) || '>' || o_orderpriority || ' ') END AS digest,
o_totalprice > 100000 AS large, round(o_totalprice::double, 2) AS price FROM orders""",
    "q_work_list": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS orders, 0::bigint AS pending FROM orders GROUP BY o_orderstatus",
    "q_newick_rows": """WITH s AS (SELECT s_nationkey, s_suppkey, floor((s_acctbal+1000)/2500)::int band, 0.5 + s_suppkey % 4 * 0.25 AS l, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor((s_acctbal+1000)/2500), s_suppkey) AS i FROM supplier),
b AS (SELECT s_nationkey, band, count(*) k, min(i) i, row_number() OVER (PARTITION BY s_nationkey ORDER BY band) AS j FROM s GROUP BY s_nationkey, band)
SELECT s_nationkey, NULL::varchar AS name, NULL::double AS confidence, NULL::double AS length, 0 AS first, sum(k)::bigint + count(*) + 1 AS size, 0 AS depth FROM b GROUP BY s_nationkey
UNION ALL SELECT s_nationkey, NULL, band*10 + 50, NULL, i - 1 + j, k + 1, 1 FROM b
UNION ALL SELECT s.s_nationkey, 'S' || lpad(s_suppkey::varchar, 8, '0'), NULL, l, s.i + j, 1, 2 FROM s JOIN b USING (s_nationkey, band)""",
    "q_locus_rows": """WITH l(locus, a, b) AS (VALUES ('l0', 1, 40), ('l1', 41, 85), ('l2', 86, 120), ('l3', 121, 900), ('l4', 901, 4000), ('l5', 4001, 4450))
SELECT doc_id, locus, b - a + 1 AS length, md5(translate(substr(text, a, b - a + 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest FROM documents, l WHERE length(text) >= b""",
    "q_hit_ranges": """WITH d AS (SELECT doc_id, min(text) t FROM documents GROUP BY doc_id),
h AS (SELECT l_orderkey, l_linenumber, l_partkey c, (l_suppkey * 131 + l_orderkey * 17) % 9000 + 1 AS a, trunc(l_extendedprice % 6000)::bigint AS k FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, c, CASE WHEN k > 0 AND l_linenumber % 3 = 0 THEN translate(reverse(substr(t, a, k + 1)), 'ACGTacgt', 'TGCAtgca') ELSE substr(t, a, k + 1) END AS s FROM h JOIN d ON d.doc_id = c)
SELECT l_orderkey, l_linenumber AS line, c AS contig, length(s)::int AS n, md5(s) AS digest FROM p WHERE s <> ''""",
    "q_partition_file": """WITH b AS (SELECT lang, max(n_chars) len FROM documents GROUP BY lang), c AS (SELECT lang, len, sum(len) OVER (ORDER BY lang)::bigint AS upto, row_number() OVER (ORDER BY lang) - 1 AS k FROM b)
SELECT k::int AS k, 'DNA, ' || lang || ' = ' || (upto - len + 1)::varchar || '-' || upto::varchar AS line FROM c""",
    "q_joined_fasta": """WITH t AS (SELECT conv_id, string_agg(translate(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '> ' || chr(10) || chr(13) || chr(9), ''), '' ORDER BY turn) s FROM conversations GROUP BY conv_id)
SELECT conv_id, (SELECT count(*) FROM t WHERE s <> '') AS named, length(s)::int AS n, md5(s) AS digest FROM t WHERE s <> ''""",
    "q_newick": """WITH s AS (SELECT s_nationkey::varchar AS tree, floor((s_acctbal+1000)/2500)::int band, 0.5 + s_suppkey % 4 * 0.25 AS l FROM supplier), b AS (SELECT tree, band, count(*) k, sum(l) l FROM s GROUP BY ALL)
SELECT tree, sum(k)::bigint AS leaves, count(*) + 1 AS "inner", round((sum(l) + 1.5*count(*))::double, 6) AS length, round(median(band*10+50)::double, 8) AS median FROM b GROUP BY tree""",
}
