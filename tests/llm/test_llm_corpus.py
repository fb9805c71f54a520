"""Near-duplicates, personal data, fingerprints, quality, decontamination and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from typeweave.llm import decontaminate, neardup, pii, quality, registry, syncmer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent=80):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows]
    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}, {i: len(s) for i, s in sets}


def near_copies(rng, base, edits):
    w = list(base)
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_of_graded_copies_against_all_pairs(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=120)
    texts = [" ".join(base)] + [near_copies(rng, base, k % 13) for k in range(90)] + [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(30)]
    texts += [texts[3]] * 5 + ["One two THREE", "one\ttwo  three", "a", "", None, " \n"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    for n in (4, 5):
        want, sizes = brute_components(rows, n)
        df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, bands string")
        got = {r["row_id"]: r for r in neardup.near_duplicates(df, shingle_words=n).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_a_large_group_of_near_copies_and_repeated_rows_against_all_pairs(spark):
    """300 different near copies, a third of them below 0.8 to the middle; some rows stand twice, some ids have two texts."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [near_copies(rng, base, k % 9) for k in range(300)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[60:80]] + [near_copies(rng, texts[8].split(), 1) for _ in range(3)]
    middle = shingles(texts[0], 4)
    below = sum(100 * len(middle & s) < 80 * len(middle | s) for s in (shingles(t, 4) for t in texts))
    assert below > 90
    rows = list(enumerate(texts))
    rows += rows[::7] * 2 + [(rows[5][0], texts[8]), (900, texts[7]), (900, "quite another text of its own here")]
    rng.shuffle(rows)
    want, _ = brute_components(rows, 4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert Counter(r["row_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(r["component_id"] == want[r["row_id"]] for r in got)


def test_near_duplicates_of_null_ids_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = Counter((r["row_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == {(None, None, True): 1, (1, 1, True): 2, (2, 1, False): 1}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_estimates_are_near_the_true_similarity():
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 1 << 63, 800, dtype=np.uint64))
    a, b = np.unique(np.append(common, rng.integers(0, 1 << 63, 100, dtype=np.uint64))), np.unique(np.append(common, rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    m = neardup.minima(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    low = (m[0] & 3) == (m[1] & 3)
    assert abs((low.mean() - 0.25) / 0.75 - 0.8) < 0.15


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [f"email:{m.start()}:{m.end()}" for m in EMAIL.finditer(text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [f"phone:{m.start()}:{m.end()}" for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(5)
    texts = [
        "", None, "@", "a@b.c+x@d.e", "a@b.c@d.e", "x" * 20000, "1" * 20000, "1 " * 20000, "1.2.3.4.5.6.7.8", "999.1.1.1 +1-2345678 +12 4111 1111 1111 1111 4111-1111-1111-1111-12",
        "\U0001f600 a@b.de \U0001f600 1.2.3.4", ".".join("1" * 3000), "+1 (2" * 3000, "a.b@c.d " * 700, "a@b " * 5000, "007.1.2.3", "4111111111111111",
    ]
    texts += ["".join(rng.choice("1234 -.+@ab()\n") for _ in range(300)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = pii.judged(pii.candidates(df), {})
    base = F.filter("spans", lambda s: s["strict"] & (s["kind"] != "secret"))
    for r in found.select("doc_id", pii.listed(base).alias("base")).collect():
        assert r["base"] == ",".join(base_spans(texts[r["doc_id"]] or "")), texts[r["doc_id"]][:80]
    clash = pii.candidates(df.withColumnsRenamed({"spans": "hits_email"}).withColumns({"parts": F.lit(1), "found": F.lit(2), "kept": F.lit(3)}))
    clash = pii.judged(clash, {})
    assert set(clash.columns) == {"doc_id", "text", "hits_email", "parts", "found", "kept", "spans"} and clash.where("parts = 1 AND found = 2 AND kept = 3").count() == len(texts)
    assert pii.candidates(df.where("false")).count() == 0
    assert pii.fitted(pii.candidates(df.where("false"))) == {}


def test_secrets_are_learned_and_texts_redacted(spark):
    rng = random.Random(7)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'mail x{k}@mail.com now, token = "{token()}" and 10.0.{k}.1 call +1 (222) 555-{1000 + k}.' for k in range(40)] + [f"word abcdefghij1klmnopqrstuvw{k} 12 34" for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df).cache()
    spans = pii.judged(found, pii.fitted(found)).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert spans[0]["clean"] == 'mail [EMAIL] now, token = "[SECRET]" and [IP] call [PHONE].'
    assert all(len(r["spans"]) == 4 for r in spans[:40])
    assert all(r["clean"] == r["text"] for r in spans[40:])


def test_texts_with_many_spans_are_redacted_like_plain_python(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a.b@c.de", "+1 (222) 555-1000", "10.1.2.3", "4111111111111111", "\U0001f600é", "plain " * rng.randrange(400)])
    texts = [" ".join(word() for _ in range(n)) for n in (1, 5, 300, 600, 6_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.judged(pii.candidates(df), {}).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect():
        spans = base_spans(r["text"])
        assert ",".join(spans) == ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"])
        at, out = 0, []
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans)):
            if start >= at:
                out += [r["text"][at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert r["clean"] == "".join(out) + r["text"][at:]


def test_fingerprints_against_neighbours(spark):
    rng = random.Random(8)
    texts = ["", None, "short", "é" * 30, "".join(rng.choice("abcdef ") for _ in range(3000)), "\U0001f600x" * 50] + ["".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r["row_id"]: r for r in syncmer.against_next(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, range int"), "doc_id", "text", parts=7).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, its = syncmer.sketch(t), syncmer.sketch(edited)
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == syncmer.written(own) and got[i]["near_edited"] == pytest.approx(syncmer.likeness(own, its))
        assert got[i]["near_next"] == pytest.approx(syncmer.likeness(own, syncmer.sketch(following)))
        assert all(np.array_equal(x, y) for x, y in zip(syncmer.read(got[i]["fingerprint"]), own))


def test_fingerprints_of_null_and_repeated_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a" * 20), (1, "a" * 20), (None, "b" * 20)], "doc_id long, text string")
    got = syncmer.against_next(df, "doc_id", "text").collect()
    assert sorted((r["row_id"] or 0) for r in got) == [0, 1, 1]
    assert syncmer.against_next(df.where("false"), "doc_id", "text").count() == 0
    one = syncmer.against_next(df.where("doc_id IS NULL"), "doc_id", "text").first()
    assert one["near_next"] == 1.0


def test_hot_and_null_ids_are_dealt_out_by_their_texts(spark):
    rng = random.Random(21)
    rows = [(rng.choice([7, 7, None, rng.randrange(20)]), "".join(rng.choice("abcd ") for _ in range(rng.randrange(8, 60)))) for _ in range(300)]
    rows += [(3, "long " * 50_000), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("clash"))
    ties = {r["text"]: r["t"] for r in df.select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    want = Counter()
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        want[i, hashlib.sha256(syncmer.edited(text, following).encode()).hexdigest()] += 1
    got = syncmer.against_next(df, "doc_id", "text", parts=9).collect()
    assert Counter((r["row_id"], r["edited_sha256"]) for r in got) == want


def test_columns_of_fingerprints_and_their_likeness(spark):
    texts = ["", None, "short", "abcdefgh " * 50, "abcdefgh " * 49 + "other words here"]
    df = syncmer.fingerprints(spark.createDataFrame([(a, b) for a in texts for b in texts], "text string, other string"))
    df = syncmer.fingerprints(df, "other", "of_other").withColumn("alike", syncmer.likeness_of("fingerprint", "of_other"))
    for r in df.collect():
        one, two = syncmer.sketch(r["text"] or ""), syncmer.sketch(r["other"] or "")
        assert (r["fingerprint"], r["of_other"]) == (syncmer.written(one), syncmer.written(two)) and r["alike"] == pytest.approx(syncmer.likeness(one, two))


def brute_anchors(text):
    codes, k, s = text, syncmer.K, syncmer.S
    inner = dict(zip(range(len(codes)), syncmer._runs(np.array([ord(c) for c in codes], np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), s, 2).tolist()))
    return [i for i in range(len(codes) - k + 1) if min(inner[j] for j in range(i, i + k - s + 1)) in (inner[i], inner[i + k - s])]


def test_anchors_are_closed_syncmers_wherever_a_passage_stands():
    rng = random.Random(9)
    text = "".join(rng.choice("abcd ") for _ in range(500))
    hashes, places = syncmer.anchors(text)
    assert places.tolist() == brute_anchors(text)
    moved, at = syncmer.anchors("xyz" * 9 + text)
    assert set(zip(hashes.tolist(), (places + 27).tolist())) <= set(zip(moved.tolist(), at.tolist()))
    assert syncmer.likeness(syncmer.sketch(text), syncmer.sketch(text)) == 1


def test_pooled_means_are_isotonic():
    y, n = np.array([0.0, 2, 1, 5, 4]), np.array([1.0, 2, 2, 5, 5])
    fit = quality.pooled(y, n)
    assert (np.diff(fit) >= 0).all() and fit @ n == pytest.approx(y.sum())
    assert fit.tolist() == pytest.approx([0, 0.75, 0.75, 0.9, 0.9])


def test_quality_accuracy_on_rows_held_out(spark, sf, duck):
    got = {r["doc_id"]: r for r in registry.op9_quality(spark, sf).collect()}
    assert len(got) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(got[i]["score"] >= 0.5, q == 1) for i, q in duck.sql("SELECT doc_id, quality FROM labels").fetchall() if i in got and got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.8 * len(held)


def test_quality_model_against_plain_numpy(spark, sf):
    """Normal equations, isotonic calibration and the query's threshold, with all rows in one matrix."""
    model = registry.quality_model(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = model[0].toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL").toPandas().groupby("doc_id")["quality"].mean()
    x = rows[quality.COLUMNS].to_numpy(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in rows["doc_id"]])
    known = rows["doc_id"].isin(labels.index).to_numpy()
    y = rows["doc_id"].map(labels).to_numpy(float)
    plain = quality.Model(x.mean(0), np.where(x.std(0) > 1e-12, x.std(0), 1.0))
    fit, calibrate = known & (fold < 2), known & (fold == 3)
    z = plain.features(x[fit])
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * fit.sum() * np.eye(z.shape[1]), z.T @ y[fit])
    assert plain.features(x) @ weights == pytest.approx(model[1].raw(x), abs=1e-5)
    raw = plain.features(x[calibrate]) @ model[1].weights
    bins = np.clip(np.floor((raw + 0.5) * quality.BINS / 2), 0, quality.BINS - 1)
    chances = model[1].chances
    assert len(chances) == len(set(bins)) and (np.diff(chances) >= -1e-12).all()
    counts = np.array([(bins == b).sum() for b in sorted(set(bins))])
    assert chances @ counts == pytest.approx(y[calibrate].sum())
    # No other non-decreasing curve is nearer to the bins' means: the largest of the least means over all runs.
    means = np.array([y[calibrate][bins == b].mean() for b in sorted(set(bins))])
    best = [max(min(means[a : b + 1] @ counts[a : b + 1] / counts[a : b + 1].sum() for b in range(k, len(means))) for a in range(k + 1)) for k in range(len(means))]
    assert chances == pytest.approx(best)
    got = {r["doc_id"]: r for r in registry.op9_quality(spark, sf).collect()}
    for i, score in zip(rows["doc_id"], model[1].score(x)):
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_quality_without_labels_rows_or_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x y"), (3, "x y")], "doc_id long, text string")
    rows = quality.statistics(df).withColumn("_y", F.lit(None).cast("double"))
    model = quality.fitted(rows, rows, "_y", F.lit(False))
    assert [r["score"] for r in quality.scored(rows, model).collect()] == [0.5] * 4
    none = rows.where("false")
    assert quality.scored(none, quality.fitted(none, none, "_y", F.lit(False))).count() == 0


def lcs(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, table[j] = table[j], last + 1 if x == y else max(table[j], table[j - 1])
    return table[-1]


def test_common_subsequence_is_the_longest():
    rng = random.Random(10)
    space = decontaminate.Space(np.ones((decontaminate.TERMS + 1, 2), np.float32), np.zeros(decontaminate.TERMS))
    for _ in range(40):
        item = " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(8, 90)))
        other = [rng.choice("abcdefgh") for _ in range(rng.randrange(120))]
        q = decontaminate.queries([(1, item)], space)[0]
        words = decontaminate._words(pa.array([" ".join(other)])).hashes.tolist()
        assert decontaminate.common(q, words)[0] == pytest.approx(lcs(item.split(), other) / len(item.split()))


def test_wide_items_are_compared_alike(monkeypatch):
    rng = random.Random(14)
    space = decontaminate.Space(np.ones((decontaminate.TERMS + 1, 2), np.float32), np.zeros(decontaminate.TERMS))
    for _ in range(20):
        item = " ".join(rng.choice("abcdefg") for _ in range(60)) + ". " + " ".join(rng.choice("abcdefg") for _ in range(12))
        other = decontaminate._words(pa.array([" ".join(rng.choice("abcdefgh") for _ in range(90))])).hashes.tolist()
        narrow = decontaminate.common(decontaminate.queries([(1, item)], space)[0], other)
        monkeypatch.setattr(decontaminate, "WIDE", 10)
        assert decontaminate.common(decontaminate.queries([(1, item)], space)[0], other) == narrow
        monkeypatch.undo()


def brute_leaks(docs, items, space):
    """All windows of all documents against all items: the checks that come after the retrieval, for every pair."""
    asked = decontaminate.queries(items, space)
    found = set()
    for d, text in docs:
        words = decontaminate._words(pa.array([text])).hashes
        listed = words.tolist()
        runs = {tuple(listed[i : i + decontaminate.RUN]) for i in range(len(listed) - decontaminate.RUN + 1)}
        for q in asked:
            own = q.words.tolist()
            if q.whole is None and any(tuple(own[i : i + decontaminate.RUN]) in runs for i in range(len(own) - decontaminate.RUN + 1)):
                found.add((d, q.item_id))
                continue
            for start in range(0, len(listed), decontaminate.STEP):
                share, answer = decontaminate.common(q, listed[max(0, start - q.margin) : start + q.width * decontaminate.STEP + q.margin])
                if share >= decontaminate.VERBATIM or (q.whole is None and share >= decontaminate.PARAPHRASE and answer >= decontaminate.ANSWER):
                    found.add((d, q.item_id))
                    break
    return found


def test_paraphrases_against_all_windows(spark, monkeypatch):
    """The cosine search finds at least 0.98 of what all windows would give, at 0.1 to 0.4 words replaced, and nothing else; blocks change nothing."""
    rng = random.Random(15)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkt" for b in "aeiou" for c in ("", "n", "r", "st", "lo", "mi")]
    word = lambda: rng.choice(vocabulary) + rng.choice(vocabulary) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "in", "a"])
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{prose(rng.randrange(12, 60))}. {prose(rng.randrange(3, 12))}.") for i in range(60)]
    docs = [(i, prose(rng.randrange(0, 250))) for i in range(60)]
    for k, (i, text) in enumerate(items * 4):
        part = (0.1, 0.2, 0.3, 0.4)[k % 4]
        docs.append((100 + k, f"{prose(rng.randrange(90))} {' '.join(word() if rng.random() < part else w for w in text.split())} {prose(60)}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    space = decontaminate.latent_space(df, bench)
    leaks = lambda: {(r["doc_id"], x["item_id"]) for r in decontaminate.with_leaks(df, bench, space).collect() for x in r["leaks"]}
    got, want = leaks(), brute_leaks(docs, items, space)
    assert got <= want and len(want) > 150
    assert len(got) >= 0.98 * len(want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1_000)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 9_000)
    assert leaks() == got


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkt" for b in "aeiou" for c in ("", "n", "r", "st", "lo", "mi")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) if rng.random() < 0.7 else rng.choice(["the", "of", "and"]) for _ in range(n))
    items = [(i, prose(rng.randrange(15, 60)) + ".") for i in range(30)]
    docs = [(i, prose(rng.randrange(0, 400))) for i in range(200)]
    planted = {}
    for k, (i, text) in enumerate(items):
        words = text.split()
        if k % 3 == 1:
            words[len(words) // 2] = "changed"
        if k % 3 == 2:
            words = [w.upper() for w in words]
        d = 200 + k
        docs.append((d, f"{prose(100)} {' '.join(words)} {prose(80)}"))
        planted[d] = i
    docs += [(None, items[0][1]), (999, None), (998, ""), (997, "word " * 3000), (200, docs[200][1])]
    df = spark.createDataFrame([(i, t, "clash", "x", "y") for i, t in docs], "doc_id long, text string, item_id string, _leaks string, leaks_0 string")
    bench = spark.createDataFrame([*items, (77, None), (78, "too short")], "item_id long, text string")
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate.with_leaks(df, bench).collect() for x in r["leaks"]}
    assert got == {*planted.items(), (None, 0)}
    assert decontaminate.with_leaks(df, bench).columns == [*df.columns, "leaks"]
    assert decontaminate.with_leaks(df.withColumn("leaks", F.lit(1)), bench, out="found").where("leaks = 1 AND _leaks = 'x'").count() == len(docs)
    assert decontaminate.with_leaks(df, bench.where("false")).where(F.size("leaks") > 0).count() == 0
    assert decontaminate.with_leaks(df.where("false"), bench).count() == 0


def test_questions_long_runs_short_items_and_items_without_id_leak(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkt" for b in "aeiou" for c in ("", "n", "r", "st", "lo", "mi")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n))
    asked, long, edited = f"{prose(30)}. {prose(10)}.", f"{prose(150)}. {prose(50)}.", f"{prose(30)}. {prose(30)}."
    items = [(1, asked), (2, long), (3, edited), (4, "Mitochondria are small"), (None, f"{prose(20)}. {prose(3)}."), (5, f"{prose(9)}.")]
    changed = edited.split()[:30]
    for k in (6, 13, 20, 27):  # leaves no run of RUN words
        changed[k] = "other"
    parts = {
        10: " ".join(asked.split()[:30]), 11: " ".join(long.split()[40:100]), 12: " ".join(changed), 13: "mitochondria ARE small",
        14: items[4][1], 15: " ".join(long.split()[60:75]),
    }
    docs = [(d, f"{prose(100)} {text} {prose(80)}") for d, text in parts.items()]
    docs += [(20 + k, prose(300)) for k in range(40)] + [(70, f"{prose(9)} mitochondria are"), (71, f"small {prose(9)}"), (72, " ".join(long.split()[:9]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], x["item_id"]) for r in decontaminate.with_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect() for x in r["leaks"]}
    assert got == {(10, 1), (11, 2), (12, 3), (13, 4), (14, None), (15, 2)}


def test_pipeline_stages_keep_columns_and_take_effect(spark, sf, duck):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).select(*(F.lit(v).cast(t).alias(c) for (c, t), v in zip(docs.dtypes, (2_000_000, f"{item} mail me at a.b@c.org", "en", "s", 1))))
    rows = docs.unionByName(copies).unionByName(leak).cache()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    f = dict(corpus_pipeline.STAGES)
    kept = f[names[1]](spark, rows, sf)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    want, _ = brute_components(list(texts.items()), 5)
    assert sorted(got) == sorted(i for i, c in want.items() if i == c)
    clean = f[names[2]](spark, rows, sf)
    assert clean.columns == docs.columns and 2_000_000 not in {r["doc_id"] for r in clean.select("doc_id").collect()}
    private = f[names[3]](spark, leak, sf).first()
    assert private["text"].endswith("mail me at [EMAIL]") and private["n_chars"] == len(private["text"])
    good = f[names[0]](spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    assert f[names[4]](spark, leak, sf).columns[:1] == ["doc_id"]
    assert f[names[3]](spark, docs.where("false"), sf).count() == 0


def test_pipeline_runs_on_the_small_tables(spark, sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()


def _dice_of_all_anchors(one, two):
    """Dice ratio over every anchor of both texts, without a sketch and without places."""
    x, y = (set(zip(h.tolist(), syncmer._times_before(h).tolist())) for h in (syncmer.anchors(t)[0] for t in (one, two)))
    return 2 * len(x & y) / (len(x) + len(y))


@pytest.mark.parametrize("insertions", [12, 20, 40, 80])
def test_scattered_edits_keep_near_copies_alike(insertions):
    rng = random.Random(insertions)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for _ in range(20):
        text = "".join(rng.choice(letters) for _ in range(12_000))
        changed = text
        for _ in range(insertions):
            at = rng.randrange(len(changed))
            changed = changed[:at] + "".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) + changed[at:]
        assert syncmer.likeness(syncmer.sketch(text), syncmer.sketch(changed)) == pytest.approx(_dice_of_all_anchors(text, changed), abs=0.15)


def test_moved_passages_count_and_scattered_words_do_not():
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1_000)) for _ in range(12)]
    text, moved = "".join(parts), "".join(rng.sample(parts, 12))
    assert syncmer.likeness(syncmer.sketch(text), syncmer.sketch(moved)) > 0.8
    found = []
    for _ in range(20):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(900)]
        one, two = " ".join(words), " ".join(rng.sample(words, 900))
        assert _dice_of_all_anchors(one, two) > 0.3
        found.append(syncmer.likeness(syncmer.sketch(one), syncmer.sketch(two)))
    assert sum(found) / len(found) < 0.12


def test_fingerprints_grow_with_the_text():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400_000))
    hashes, places = syncmer.sketch(text)
    assert len(hashes) > 1_500 and len(syncmer.sketch(text[:6_000])[0]) == syncmer.ANCHORS
    shared = syncmer.likeness((hashes, places), syncmer.sketch(text[:20_000]))
    assert shared == pytest.approx(_dice_of_all_anchors(text, text[:20_000]), abs=0.03)
    assert all(np.array_equal(x, y) for x, y in zip(syncmer.read(syncmer.written((hashes, places))), (hashes, places)))


@pytest.mark.parametrize("kind, ids", [("string", ["b", "a", None]), ("int", [7, 3, None]), ("decimal(20,0)", [Decimal(10**19), Decimal(5), None])])
def test_items_have_ids_of_any_type(spark, kind, ids):
    texts = ["which river runs through the old town of the valley. it is the green river", "how many bridges did the miller build in the north. he built seven of them", "who kept the keys of the tower when the king was away. his sister kept them"]
    bench = spark.createDataFrame([*zip(ids, texts)], f"item_id {kind}, text string")
    bench = bench.withColumn("item_id", F.col("item_id").cast(kind))
    df = spark.createDataFrame([(1, " ".join(texts)), (2, texts[1]), (3, "nothing of it here"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.with_leaks(df, bench).collect()}
    known = sorted(i for i in ids if i is not None)
    assert found == {1: [*known, None], 2: [ids[1]], 3: [], 4: []}


def test_names_of_sets_are_wide():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 3, 50, 0, 50)]
    sets.append(sets[3])
    at = np.cumsum([0, *map(len, sets)])
    names = [int(x) for x in neardup._names(np.concatenate(sets), at).to_pylist()]
    assert names[3] == names[6] and len(set(names)) == len(sets) - 1 and max(names) < 1 << 122 and names[4] == 0
    low, high = 0, 0
    for h in sets[3].tolist():  # the same sums by plain integers
        low = (low + int(neardup.mixed(np.array([h ^ 5], np.uint64))[0])) % (1 << 64)
        high = (high + int(neardup.mixed(np.array([h ^ 11], np.uint64))[0])) % (1 << 64)
    assert names[3] == (high >> 6) << 64 | low
