"""Every operator and every stage with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from typeweave.llm import bpe, chat, decontaminate, html, neardup, pii, quality, registry, shard, syncmer, url_filter
from typeweave.sources.tables import handed_over

CLASHES = """_leaks leaks_0 all_leaks _all_leaks votes _votes path_ _path found _found best hits_email _hits_email gaps_ip parts kept _kept _spans score_ _score _stat_log_bytes node members
 key planes bands range_ tie extra to place _place _range _cell _bucket _in_cell _offset _all _row _rows _source _shuffle _fraction _rank batch id row times label _label _calibrates least _block odd head ready""".split()
LONG = "".join(random.Random(1).choice(["the ", "a.b@c.de ", "1.2.3.4 ", "Word{} ", "é\U0001f600 ", "\n", "<p>x</p> ", "<s> "]) for _ in range(20_000))


def documents(spark):
    rows = [(1, "One two three four five six seven.", "s", "en"), (1, "One two three four five six seven.", "s", "en"), (2, None, None, None), (3, "", "s", "en"), (None, "lost id a b c d", "t", None), (None, None, None, None), (4, LONG, "t", "en"), (5, " \n\t", "t", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit(f"in {c}") for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


def bench(spark):
    return spark.createDataFrame([(1, "what is the answer to this question. it is forty two"), (None, "no id here at all"), (2, None), (3, "")], "item_id long, text string")


def scored(df):
    rows = quality.statistics(df.drop("_stat_log_bytes"), keep_text=True)
    model = quality.fitted(rows, rows.withColumn("y", F.lit(1.0)), "y", F.lit(False))
    return quality.scored(rows, model)


def judged(df):
    found = handed_over(pii.candidates(df), "candidates")
    return pii.judged(found, pii.fitted(found))


def coded(df):
    codec = bpe.shared(df, registry.tokenizer_path())
    return bpe.decoded(bpe.encoded(df, "text", codec), "token_ids", codec, "decoded")


#: Those that add columns to their input.
ADDS = {
    "decontaminate": lambda df: decontaminate.with_leaks(df, bench(df.sparkSession)),
    "html": lambda df: html.main_text(df, url="source", page="lang"),
    "pii": judged,
    "bpe": coded,
    "quality": scored,
    "url_filter": lambda df: url_filter.judged(df, "text", registry.URL_RULES, "allow"),
    "fingerprints": lambda df: syncmer.fingerprints(df),
}
#: Those that give rows of their own, one for each input row.
MAKES = {
    "shard": lambda df: shard.interleaved(df, 3),
    "neardup": lambda df: neardup.near_duplicates(df),
    "against_next": lambda df: syncmer.against_next(df, "doc_id", "text"),
}


@pytest.mark.parametrize("name", [*ADDS, *MAKES])
def test_operator_on_odd_rows_and_clashing_columns(name, spark):
    df = documents(spark)
    out = (ADDS | MAKES)[name](df)
    got = out.collect()
    assert len(got) == 8
    if name in ADDS:
        kept = [c for c in CLASHES if not (name == "quality" and c == "_stat_log_bytes")]
        assert all(r[c] == f"in {c}" for r in got for c in kept)
    assert (ADDS | MAKES)[name](df.where("false")).count() == 0


def test_results_on_odd_rows(spark):
    df = documents(spark)
    by_id = lambda rows: {r["doc_id"]: r for r in rows}
    assert by_id(coded(df).collect())[4]["decoded"] == LONG and by_id(coded(df).collect())[2]["token_ids"] == []
    assert all(r["leaks"] == [] for r in ADDS["decontaminate"](df).collect())
    assert [len(by_id(judged(df).collect())[i]["spans"]) for i in (2, 3, 5)] == [0, 0, 0]
    near = neardup.near_duplicates(df).collect()
    assert sorted((r["row_id"] or 0, r["n_shingles"], r["component_id"]) for r in near if r["row_id"] != 4) == [(0, 0, None), (0, 2, None), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (5, 0, 5)]
    sizes = {r["row_id"]: r["size"] for r in shard.interleaved(df, 3).collect()}
    assert sizes[2] == 1 and sizes[4] == len(LONG.encode()) + 1


def test_chat_on_odd_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, None, None, None), (None, 0, "assistant", ""), (3, 0, "assistant", "x"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(c) for c in ("turns", "at", "example", "context", "conv", "formatted", "reply", "body")})
    got = chat.examples(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))).collect()
    assert sorted((r["conv_id"] or 0, r["example"], len(r["loss"])) for r in got) == [(0, 0, 0), (1, 0, len(LONG)), (2, 0, 0), (3, 0, 1), (3, 1, 1)]
    assert chat.examples(df.where("false")).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_on_odd_rows_and_clashing_columns(stage, spark, sf):
    import corpus_pipeline

    df = documents(spark)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, df, sf)
    got = out.collect()
    if stage < 4:
        assert out.columns == df.columns
        assert all(r[c] == f"in {c}" for r in got for c in CLASHES)
    assert len(got) == {1: 7, 2: 8, 3: 8, 4: 8}.get(stage, len(got)), name
    assert run(spark, df.where("false"), sf).count() == 0


def test_personal_data_found_by_kind(spark, sf, duck):
    """Every span of each base kind that plain patterns find in the documents is among the query's."""
    from test_llm_corpus import base_spans

    got = {r["doc_id"]: r for r in registry.op6_pii(spark, sf).collect()}
    found, all_of = {}, {}
    for i, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        listed = set(got[i]["spans"].split(","))
        assert got[i]["n_spans"] == len(listed - {""})
        for s in base_spans(text or ""):
            kind = s.split(":")[0]
            all_of[kind] = all_of.get(kind, 0) + 1
            found[kind] = found.get(kind, 0) + (s in listed)
    assert found == all_of and set(all_of) >= {"email", "ip", "card", "phone"}
