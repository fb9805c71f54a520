"""Phrases, toxicity and conversation repair against plain Python."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from typeweave.llm import phrases, registry, repair, syncmer, toxicity

# ---- phrases


def plain_collocations(rows, least=100, longest=5, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= often[p[i : i + k]]}
        ranks = []
        for p, a in often.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                ranks.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranks)[:top], 1)}
    return out


PHRASE_ROWS = [
    ("The quick, the quick brown fox! The quick brown fox", "en"), ("a a a a a a a", "en"), (None, "en"), ("", None), ("x y\tx y  x y\nx y", None), ("É été été é", "fr"),
    ("one two three four five six seven " * 6, "en"), ("one two three four five six seven " * 6, "en"), (".,;", "de"), ("\x00 \x00 \x00 b", "und"), ("A.B:C d\x0be d e", "en"),
]


@pytest.mark.parametrize("sent, words", [(2_000_000, 3), (0, 1 << 20)])
def test_phrases_against_plain_counts(sent, words, spark, monkeypatch):
    """Frequent groups sent or joined, and chunks of a few words, give the same rows."""
    monkeypatch.setattr(phrases, "MOST_SENT", sent)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", words)
    df = spark.createDataFrame(PHRASE_ROWS, "text string, lang string").withColumns({c: F.lit("x") for c in ("chunk", "words", "id", "key", "steps")})
    for least, longest, top in ((2, 5, 2000), (1, 3, 4)):
        got = phrases.collocations(df, least=least, longest=longest, top=top).collect()
        assert {tuple(r) for r in got} == plain_collocations(PHRASE_ROWS, least, longest, top) and len(got) == len({tuple(r) for r in got})
    assert phrases.collocations(df.where("false")).count() == 0


def test_phrase_groups_joined_over_chunks_and_batches(spark, monkeypatch):
    """Occurrences that are joined by group come back to their chunks, also where an Arrow batch ends within one."""
    monkeypatch.setattr(phrases, "MOST_SENT", 0)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 9)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = phrases.collocations(spark.createDataFrame(PHRASE_ROWS, "text string, lang string"), least=2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    assert {tuple(r) for r in got} == plain_collocations(PHRASE_ROWS, 2)


def test_phrase_relations_are_read_in_bounded_parts(spark, monkeypatch):
    """However many chunks a task writes, no row group, which Spark reads whole, is much larger than allowed."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 10_000)
    monkeypatch.setattr(phrases, "ROW_GROUP_BYTES", 1 << 18, raising=False)
    text = F.expr("concat_ws(' ', transform(sequence(1, 1000), x -> concat('w', pmod(hash(id, x), 50000), if(x % 10 = 0, '.', ''))))")
    chunks = phrases.relation(spark.range(0, 400, 1, 1).select(text.alias("text"), F.lit("en").alias("lang")))
    groups = [m.row_group(k) for f in chunks.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
    assert max(g.total_byte_size for g in groups) < 2 << 18
    assert sum(g.num_rows for g in groups) == chunks.count() > 20
    assert chunks.select(F.explode("times").alias("n")).agg(F.sum("n")).first()[0] == 400_000


@pytest.mark.parametrize("values", [[], [0], [255, 0], [256, 1], [1 << 16], [1 << 32, 7]])
def test_phrase_places_packed_and_unpacked(values):
    packed = phrases._packed(np.array(values, np.int64))
    assert phrases._unpacked(pa.scalar(packed, pa.binary())).tolist() == values


def test_phrase_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(5 * 10**14, 9 * 10**15, 7 * 10**14, 6 * 10**14)], "a long, n long, l long, r long")
    got = df.select(phrases._score(*map(F.col, "anlr"), 1000)).first()[0]
    assert got == 1000 * 5 * 10**14 * 9 * 10**15 // (7 * 10**14 * 6 * 10**14)


def test_phrase_query_matches_sql_and_plain_counts(spark, sf, duck):
    found = registry.op11_phrases(spark, sf)
    same_rows(found, duck.sql(registry.PHRASE_SQL))
    assert {tuple(r) for r in found.collect()} == plain_collocations(duck.sql("SELECT text, lang FROM documents").fetchall())


# ---- toxicity


def plain_maximal(scores):
    """All maximal segments by their definition: the best one of the whole, then of what stands left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    right = [(s, x + b, y + b) for s, x, y in plain_maximal(scores[b:])]
    return plain_maximal(scores[:a]) + [(best[0], a, b)] + right


def test_maximal_segments_against_their_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 4.0]) + rng.random() / 8 for _ in range(rng.randrange(0, 25))]
        want = plain_maximal(scores)
        for got in (toxicity.maximal_segments(scores), toxicity._segments(np.array(scores))):
            assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
            assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def test_odds_of_unseen_forms_follow_their_stem():
    import pyarrow as pa

    from typeweave.llm.arrays import Texts

    table = np.zeros((2, toxicity.BUCKETS), np.int64)
    for k, words in enumerate(("the wretchling wretchend wretchis and house " * 20, "the and house tree wrench " * 40)):
        t = toxicity.Tokens(Texts(pa.array([words])))
        for level in t.cells:
            np.add.at(table[k], level[t.number], 1)
    odds = toxicity.Odds(table[0], table[1], (120, 200))
    t = toxicity.Tokens(Texts(pa.array(["Wretchoid the unseen wrench"])))
    bad, the, unseen, wrench = odds.scores(t.cells)[t.number]
    assert bad > 1 > 0 > max(the, unseen, wrench)


def test_toxic_passages_and_held_out_accuracy(spark):
    rng = random.Random(8)
    plain, bad = [f"w{i}" for i in range(800)], ["vilest", "vilely", "vilenk", "scabrous", "scabby"]
    rows = []
    for i in range(600):
        words = rng.choices(plain, k=rng.randrange(5, 200))
        if i % 5 == 0:
            a = rng.randrange(len(words))
            words[a:a] = [x for _ in range(rng.randrange(2, 6)) for x in (rng.choice(bad), rng.choice(plain))]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    rows += [(600, None, 0), (601, "", 0), (602, " .!", 0), (603, " ".join(rng.choices(plain, k=50_000)) + " vilest scabby vilely", 1), (None, "vilest", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({c: F.lit(f"in {c}") for c in ("_found", "_tokens", "label", "half")})
    labels = df.where("doc_id % 3 <> 0").select("doc_id", "toxic")
    labels = labels.unionByName(labels.limit(0)).unionByName(spark.createDataFrame([(9999, 1), (None, 1), (1, None)], "doc_id long, toxic int"))
    model = toxicity.fitted(df, labels)
    got = toxicity.scored(df, model).collect()
    assert len(got) == len(rows) and all(r["_found"] == "in _found" and r["_tokens"] == "in _tokens" for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 3 == 0]
    assert sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1 and (r["doc_id"] not in (600, 601, 602) or (r["score"] < 0.5 and r["toxic_spans"] == []))
        for s in r["toxic_spans"]:
            assert any(b in r["text"].encode()[s["start"] : s["end"]].decode() for b in bad)
    assert max(r["toxic_spans"][-1]["end"] for r in got if r["doc_id"] == 603) == len(rows[603][1].encode())
    assert toxicity.scored(df.where("false"), model).count() == 0
    assert {r["score"] > 0.01 for r in toxicity.scored(df, toxicity.fitted(df, labels.where("false"))).collect()} == {False}
    only = toxicity.fitted(df, labels.where("toxic = 0"))
    assert {r["score"] > 0.5 for r in toxicity.scored(df, only).collect()} == {False}


def test_toxicity_query_on_all_documents(spark, sf, duck):
    got = {r["doc_id"]: r for r in registry.op12_toxicity(spark, sf).collect()}
    ids = [i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()]
    assert sorted(got) == sorted(ids)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    labelled = duck.sql("SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id)").fetchall()
    assert sum(got[i]["predicted"] == y for i, y in labelled) >= 0.95 * len(labelled)


# ---- conversation repair

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """By a search over (row, state) that takes up states in the order of cost and audit."""
    out, after, name = {}, {0: 2, 1: 2, 3: 2, 2: 3}, {2: "user", 3: "assistant"}
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    for conv, v in plain_damage(rows).items():
        v.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
        turns = [t for t, _, _ in v if t is not None]
        seen, faults = set(), []
        for _, role, text in v:
            body = text.strip(SPACE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in v]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        heap, done = [(0, "", 0, 0, ())], set()
        while heap:
            cost, audit, i, s, told = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done.add((i, s))
            if i == len(v) and s in (0, 3):
                out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
                break
            heapq.heappush(heap, (cost + 5, audit + "I", i, after[s], (*told, f"{name[after[s]]}:")))
            if i < len(v):
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, told))
                if faults[i] not in ("blank", "duplicate"):
                    more, (_, role, text) = 5 * (faults[i] == "truncated"), v[i]
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after[s], (*told, f"{name[after[s]]}:{text}")))
                    if s in kept.get(role[:1], {}):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept[role[:1]][s], (*told, f"{role}:{text}")))
    return out


def repaired_of(df):
    rows = repair.ordered(registry.damaged(df))
    found = registry.handed_over(repair.edits(rows), "repair-edits")
    return {r["conv_id"]: tuple(r)[1:] for r in repair.audited(df.select("conv_id"), "conv_id", rows, found).collect()}


def test_repair_of_odd_conversations_against_a_plain_search(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No", "ok! ", "", " \t", "a b?", None, "né.\n", "x ", "long " * 5000 + "."]
    rows = [
        (c or None, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"turn {t}.")
        for c in range(250) for t in range(rng.choice([1, 2, 3, 5, 8, 20]))
    ]
    rows += [(900, 1, "user", "Hi.")] * 4 + [(901, t, "system", None) for t in range(5)]
    rows += [(902, t, ["user", "assistant", "user", "system"][t * 7 % 4], ["Go on.", f"t{t}!", f"t{t}", ""][t * t * 5 % 4]) for t in range(3000)]  # one long conversation: 55 blocks
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "place", "fault", "block", "symbols", "first")})
    want = plain_repair(rows)
    got = repaired_of(df)
    assert set(got) == {r[0] for r in rows}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: want.get(c, empty) for c in got}
    assert repaired_of(df.where("false")) == {}


def test_repair_query_against_a_plain_search(spark, sf, duck):
    rows = duck.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    want = plain_repair(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.op13_repair(spark, sf).collect()}
    assert got == {c: want[c] for c in got} and set(got) == {r[0] for r in rows}


# ---- fingerprints of all anchors, and ids of other types


def test_fingerprints_of_all_anchors_and_of_string_ids(spark):
    rng = random.Random(4)
    texts = {f"d{k:03d}": "".join(rng.choices("abcdefgh ", k=rng.randrange(0, 900))) for k in range(30)}
    texts["d005"] = texts["d006"][:-40] + "xyz" * 9
    df = spark.createDataFrame([*texts.items(), (None, "lost")], "doc_id string, text string")
    for least in (None, syncmer.ANCHORS):
        got = {r["row_id"]: r for r in syncmer.against_next(df, "doc_id", "text", least=least).collect()}
        assert len(got) == 31
        order = sorted(texts, reverse=True)
        for a, b in zip(order, order[1:]):
            one, two = syncmer.sketch(texts[a], least), syncmer.sketch(texts[b], least)
            assert got[a]["fingerprint"] == syncmer.written(one) and got[a]["near_next"] == pytest.approx(syncmer.likeness(one, two, least))
            assert got[a]["edited_sha256"] == hashlib.sha256(syncmer.edited(texts[a], texts[b]).encode()).hexdigest()
    hashes, places = syncmer.sketch(texts["d000"] * 20, None)
    assert sorted(places.tolist()) == syncmer.anchors(texts["d000"] * 20)[1].tolist() and len(hashes) > 1_000
