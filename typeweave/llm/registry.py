"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import bpe, chat, decontaminate, html, neardup, phrases, pii, quality, repair, shard, syncmer, toxicity, url_filter
from typeweave.sources.tables import handed_over, table

URL_RULES = [
    url_filter.Rule("allow", "org"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page URLs judged by five rules; what no rule fits is allowed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, "url", URL_RULES, default="allow").select("page_id", "host", "path", "rule", "verdict")


URL_SQL = """
WITH r AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs where the item leaks into the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all conversations and one more, read back into digests by conversation."""
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.examples(rows).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")))
    # The last example of a conversation has all of its turns.
    whole = made.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count_if(F.col("target_turn").isNotNull()).alias("n_examples"),
    )
    turns = chat.turns_back(F.col("formatted"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
        "n_examples",
    )


CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '(<|\[)(\\*)(\||/?s>|/?SYS>>|/?INST\])', '\1\2\\\3', 'g') AS body FROM c),
w AS (SELECT *, length('<|turn|>' || role || chr(10) || body || '<|end|>' || chr(10)) AS chars FROM e),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM w)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR back = 1)::bigint AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM p GROUP BY conv_id
"""


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal row counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shard.interleaved(docs, shards=8).select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "position",
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on shingles of four words."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4).withColumnRenamed("row_id", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = handed_over(pii.candidates(docs).drop("text"), "pii-candidates")
    spans = pii.judged(found, pii.fitted(found))
    base = F.filter("spans", lambda s: s["strict"] & s["kind"].isin(pii.BASE_KINDS))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmer.against_next(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.shared(docs, tokenizer_path())
    back = bpe.decoded(bpe.encoded(docs, "text", codec, keep_text=False), "token_ids", codec, "decoded")
    return back.select(
        "doc_id",
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: bool = False) -> tuple[DataFrame, quality.Model]:
    """The written statistics of all rows of ``docs``, and a model learned from labels whose rows aren't held out.

    The statistics stand beside doc_id, or beside all columns of ``docs`` if these are kept.
    """
    rows = handed_over(quality.statistics(docs if keep else docs.select("doc_id", "text"), keep_text=keep), "quality-statistics")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    labels = labels.where(fold != 2).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    labelled = rows.select("doc_id", *quality.COLUMNS).join(labels, "doc_id")
    return rows, quality.fitted(rows, labelled, "label", fold == 3)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    rows, model = quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    return quality.scored(rows, model).select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of two to five words in all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


PHRASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
tot AS (SELECT lang, sum(len(ws))::bigint AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
inner_ AS (SELECT DISTINCT lang, k - 1 AS k, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) AS phrase, a FROM c WHERE k > 2),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.phrase = c.phrase AND x.a >= c.a)),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS h, array_to_string(ws[j + 1:k], ' ') AS t FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, n, j, ((1000::hugeint * cut.a * n) // (x.a::hugeint * y.a))::bigint AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = cut.h JOIN f y ON y.lang = cut.lang AND y.phrase = cut.t JOIN tot ON tot.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.scored(docs, model, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("toxic_spans").cast("bigint").alias("n_passages"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with a fifth of the rows dropped, emptied, cut, repeated or given to the user, by the checksum of conversation and turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of all conversations after damage."""
    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.ordered(damaged(original))
    found = handed_over(repair.edits(rows), "repair-edits")
    return repair.audited(original.select("conv_id"), "conv_id", rows, found)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_html_extract": op3_html_extract,
    "op4_shard": op4_shard,
    "op5_neardup": op5_neardup,
    "op6_pii": op6_pii,
    "op7_fingerprint": op7_fingerprint,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_phrases": op11_phrases,
    "op12_toxicity": op12_toxicity,
    "op13_repair": op13_repair,
}
ORACLE_SQL = {"op2_chat_format": CHAT_SQL, "op10_url_filter": URL_SQL, "op11_phrases": PHRASE_SQL}
