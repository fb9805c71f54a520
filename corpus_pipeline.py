"""A training corpus from raw documents: quality, near-duplicates, benchmarks, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a
DataFrame; all but the last return the columns of ``docs``, with any extra ones,
whatever their names.

Defined results: documents with null or empty texts are scored, searched and encoded
like others (as empty ones), and have no near-duplicates; rows with a null id are
documents of their own; of repeated rows of one id one stays, with the least text;
very long texts are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.llm import bpe, decontaminate, neardup, pii, quality
from typeweave.llm.registry import quality_model, tokenizer_path
from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over, table

QUALITY = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY."""
    clashing = [c for c in docs.columns if c in quality.COLUMNS]
    aside = dict(zip(clashing, unused([*docs.columns, *quality.COLUMNS], *clashing)))
    statistics, model = quality_model(spark, docs.withColumnsRenamed(aside), sf_dir, keep=True)
    score, = unused(statistics.columns, "score")
    good = quality.scored(statistics, model, score=score).where(F.col(score) >= QUALITY)
    return good.select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; five-word shingles, similarity 0.8."""
    found = neardup.near_duplicates(docs).where("row_id IS NOT NULL").groupBy(F.col("row_id").alias("doc_id"))
    found = handed_over(found.agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("times")), "kept-ids")
    # The written ids' size decides whether they are broadcast.
    rest = docs.join(handed_over(found.where("NOT kept OR times > 1").select("doc_id"), "left-out"), "doc_id", "left_anti").select(docs.columns)
    again = handed_over(found.where("kept AND times > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return rest
    row = F.struct(*docs.columns)
    one = docs.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
    return rest.unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    leaks, = unused(docs.columns, "leaks")
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"), out=leaks)
    return found.where(F.size(leaks) == 0).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced by their kind; n_chars follows the text."""
    model = pii.fitted(handed_over(pii.candidates(docs.select("text")).drop("text"), "pii-candidates"))
    spans, = unused(docs.columns, "spans")
    found = pii.judged(pii.candidates(docs, out=spans), model, column=spans, out=spans)
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, and their count."""
    codec = bpe.shared(docs, tokenizer_path())
    return bpe.encoded(docs.select("doc_id", "text"), "text", codec, keep_text=False).withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding", tokens),
]
#: Stages 1, 3 and 4 learn models, which SQL can't express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = handed_over(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
