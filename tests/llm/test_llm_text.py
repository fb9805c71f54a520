"""Chat formatting, URL filters, HTML extraction, BPE and sharding."""

import hashlib
import random
import re
import zlib

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from typeweave.llm import bpe, chat, html, registry, shard, url_filter
from typeweave.llm.arrays import Texts, Words


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, duck):
    same_rows(registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLE_SQL[name]))


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def made(spark, rows):
    df = chat.examples(spark.createDataFrame(rows, CHAT))
    return df.select("*", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), chat.turns_back(F.col("formatted")).alias("turns"))


def test_every_assistant_turn_is_an_example_with_all_before_it(spark):
    rows = [(1, 2, "user", "b?", ""), (1, 0, "user", "a?", ""), (1, 1, "assistant", "a!", ""), (1, 3, "assistant", "b!", ""), (1, 4, "user", "c?", "")]
    got = sorted(made(spark, rows).collect(), key=lambda r: r["example"])
    assert [(r["example"], r["target_turn"], r["loss"], len(r["turns"])) for r in got] == [(0, 1, "a!", 2), (1, 3, "b!", 4), (2, None, "", 5)]
    assert got[1]["formatted"].startswith(got[0]["formatted"])


def test_control_strings_nulls_ties_and_odd_roles_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\\\/s> <|turn|> <|end|>\n", None, "", "[\\INST] \\ <<SYS>>x<</SYS>> <\\|", "\U0001f600 <s>" * 3]
    rows = [(k, t, role, x, "z") for k, role in enumerate(["user", "assistant", None, "a\nb\\n<|end|>"]) for t, x in enumerate(texts)]
    for conv, part in ((k, [r for r in rows if r[0] == k]) for k in range(4)):
        last = max(made(spark, part).collect(), key=lambda r: r["example"])
        assert [(t["role"], t["text"]) for t in last["turns"]] == [(r[2] or "", r[3] or "") for r in part], conv
    tied = [(9, 0, "user", "<s>", ""), (9, 0, "user", "<a>", ""), (9, None, "user", "first", "")]
    assert [t["text"] for t in made(spark, tied).first()["turns"]] == ["first", "<a>", "<s>"]
    long = "<s> é " * 200_000
    assert made(spark, [(9, 0, "assistant", long, "")]).first()["loss"] == long
    again = [(9, 0, "user", "x", ""), (9, 0, "user", "x", "")]
    assert len(made(spark, again).first()["turns"]) == 2
    assert made(spark, []).count() == 0
    assert made(spark, [(None, 0, "assistant", "n", "")]).first()["loss"] == "n"


URLS = [
    None, "", "no scheme", "http://a.example.org/es/x", "http://example.org/en/12?x=/de/", "HTTP://WWW.Example.ORG", "http://notexample.org/en/1", "x://com/fr/", "x://a.b.com/de/1",
    "x://com/frx", "http://a.org#/x", "http://a.net/", "p://q://r/s", "http://", "http:///p", "http://example.org:80/en/1", "http://example.org/\nen/1",
]


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):], re.S)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)


def test_trie_and_join_agree_with_all_rules_in_turn(spark, monkeypatch):
    rng = random.Random(2)
    hosts, paths = ["com", "a.com", "b.a.com", "org", "example.org"], ["/", "/x", "/x/", "/x/y", "/x/yz/", "/es/", "/en/1"]
    rules = registry.URL_RULES + [url_filter.Rule("allow", "org", "/aaaaaaaaaaaa"), url_filter.Rule("block", "example.org", "/a"), url_filter.Rule("block", "org", "/")] + [url_filter.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(12)]
    urls = URLS + [f"http://{rng.choice(['', 'w.', 'z.w.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y/z', '/x/yz/1', '/en/12', '/xx'])}" for _ in range(60)]
    urls += ["http://example.org/aaaaaaaaaaaaa", "http://example.org/aaa", "http://example.org/" + "a/" * 20_000]
    df = spark.createDataFrame([(i, u, "clash", "x", "y") for i, u in enumerate(urls)], "id long, url string, host string, found string, best string")
    want = {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(url_filter, "TRIE_BYTES", limit)
        got = url_filter.judged(df, "url", rules, "allow").collect()
        assert len(got) == len(urls)
        for r in got:
            host, path, rule = want[r["id"]]
            assert (r["found"], r["best"]) == ("x", "y")
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule.name, rule.verdict if rule else "allow"), urls[r["id"]]
    assert url_filter.judged(df.where("false"), "url", rules, "allow").count() == 0
    with pytest.raises(ValueError):
        url_filter.Rule("maybe", "x")


PAGE = """<html><body class="has-sidebar"><div class="cookie-notice">We use <b>cookies</b></div><header><h1>Site</h1></header><div id="content"><div class="post post-{n}"><h1>Head &amp; line {n}</h1>
<p>First para with <a href=x>link</a> and   more text &eacute;.<p>Second<br>line<ul><li>one<li>two</ul><div class="share-buttons">tweet</div><form><input>Go</form><script>if(a<b){{"</p>"}}</script><blockquote>Quote <i>it</i></blockquote></div>
<aside>side</aside><section id="comments"><article class="comment"><p>nice post with a very long comment that goes on and on and on and on and on and on and on</p></article></section></div><div class="sidebar2">x</div><footer>f</footer></body>"""


def test_main_text_and_broken_markup(spark):
    rows = [(n, f"http://h.net/{n}", PAGE.format(n=n), "clash", "kept") for n in range(6)] + [(10, None, None, "", ""), (11, "x", "", "", ""), (12, "http://h.net/z", "plain &lt;b&gt; text", "", "")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, path string")
    df = df.withColumns({c: F.lit(c) for c in ("_path", "votes", "_votes", "host", "paths")})
    got = html.main_text(df).collect()
    assert all((r["_path"], r["votes"], r["_votes"]) == ("_path", "votes", "_votes") for r in got)
    assert len(got) == 10
    for r in got:
        if r["page_id"] < 10:
            assert r["text"] == f"Head & line {r['page_id']}\nFirst para with link and more text é.\nSecond line\none\ntwo\nQuote it" and r["path"] == "kept"
        assert r["n_chars"] == len(r["text"])
    by_id = {r["page_id"]: r for r in got}
    assert by_id[10]["text"] == by_id[11]["text"] == "" and by_id[12]["text"] == "plain <b> text"
    assert html.main_text(df.where("false")).count() == 0


def test_hosts_vote_for_a_container_that_one_page_would_miss(spark):
    long, short = "word " * 60, "word " * 5
    page = lambda main, junk: f"<body><div class='m1'><p>{main}</p></div><div class='k2'><p>{junk}</p></div></body>"
    rows = [(n, "http://h.org/", page(long, short)) for n in range(9)] + [(9, "http://h.org/", page(short, long))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == short.strip() and got[0] == long.strip()


def test_text_beside_the_winning_container_is_kept(spark):
    words = lambda n, w: " ".join([w] * n)
    one = "<body><div class='wrap'><div class='title'><h2>{t}</h2></div><div class='lead'><p>{l}</p></div><div class='text'><p>{x}</p></div><div class='more'><a href=x>{m}</a></div></div></body>"
    two = "<body><div class='first'><p>{x}</p></div>{m}<div class='second'><p>{l}</p></div></body>"
    rows = [(n, "http://h.io/", one.format(t=f"head {n}", l=words(20, "lead"), x=words(180, "text"), m="all else")) for n in range(40)]
    rows.append((40, "http://h.io/", two.format(x=words(60, "first"), l=words(50, "second"), m="loose")))
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(40):
        assert got[n]["text"] == "\n".join([f"head {n}", words(20, "lead"), words(180, "text")]) and got[n]["paths"] == [">body>div.wrap"]
    assert got[40]["text"] == "\n".join([words(60, "first"), "loose", words(50, "second")])


def test_region_is_the_least_one_that_holds_all_winners():
    page = "<body><div class='page'><div class='a'><div class='a1'><p>one</p></div></div><div class='b'><p>small</p></div><div class='c'><div><p>two</p></div></div></div><div class='z'><p>junk</p></div></body>"
    text, paths = html.extracted(page, {">body>div.page>div.a>div.a1": 5.0, ">body>div.page>div.c>div": 4.0})
    assert text == "one\nsmall\ntwo" and paths == [">body>div.page"]
    only = "<body><div class='page'><div class='a'><p>one</p></div></div></body>"
    assert html.extracted(only, {">body>div.page>div.a": 5.0}) == ("one", [">body>div.page>div.a"])


def test_words_that_articles_bear_have_a_vote(spark):
    page = "<body><div class='search-article'><p>{}</p></div><div class='footer'>f</div></body>"
    other = "<body><div class='a'><p>{}</p></div><div class='notice'>n</div></body>"
    rows = [(n, "http://s.org/", page.format(f"text {n}")) for n in range(4)] + [(n, "http://t.org/", other.format(f"text {n}")) for n in range(4, 8)] + [(8, "http://t.org/", page.format("x"))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{n: f"text {n}" for n in range(8)}, 8: ""}


def test_deep_and_unclosed_pages_are_read_whole_in_linear_time():
    n = 30_000
    page = "<div class=a><p>x y" * n
    text, _ = html.extracted(page, html.shares(page))
    assert text == "\n".join(["x y"] * n)
    assert html.extracted("<b>x</i>" * n, {})[0] == "x" * n
    nested = "<div>" * n + "<p>deep</p>" + "</div>" * n
    assert html.extracted(nested, html.shares(nested))[0] == "deep"


def brute_votes(pages):
    """Shares of container paths from a plain walk over page trees (tag, class, text, children), as the module's text defines them."""
    votes = {}
    for host, tree in pages:
        score = {}

        def walk(node, above, path):
            name, text, below = node
            path = f"{path}>{name}"
            above = [*above, path]
            if text:
                score[above[-1]] = score.get(above[-1], 0) + len(text)
                if len(above) > 1:
                    score[above[-2]] = score.get(above[-2], 0) + len(text) / 2
            for child in below:
                walk(child, above, path)

        walk(tree, [], "")
        for p, s in score.items():
            votes.setdefault(host, {}).setdefault(p, []).append(s / sum(score.values()))
    out = {}
    for host, found in votes.items():
        sums = {p: sum(v) for p, v in found.items()}
        out[host] = {p: v for p, v in sums.items() if v >= 0.2 * max(sums.values()) and v >= 0.02 * sum(sums.values())}
    return out


def test_votes_of_random_templates_against_a_plain_walk(spark):
    rng = random.Random(13)

    def grown(depth):
        children = [grown(depth + 1) for _ in range(rng.randrange(3))] if depth < 5 else []
        return (f"div.c{rng.choice('abc')}", "w" * rng.randrange(60), children)

    def written(node):
        name, text, below = node
        tag, _, kind = name.partition(".")
        return f"<{tag} class={kind}>{text}{''.join(map(written, below))}</{tag}>"

    pages = [(f"h{k % 3}", ("body.b", "", [grown(0) for _ in range(3)])) for k in range(60)]
    df = spark.createDataFrame([(h, written(t)) for h, t in pages], "host string, html string")
    got = {r["host"]: r["votes"] for r in html.winning_paths(df, "html").collect()}
    want = brute_votes(pages)
    assert got.keys() == want.keys()
    for host, votes in want.items():
        assert got[host] == pytest.approx(votes)


@pytest.mark.parametrize("page, text", [("<", "<"), ("<p", ""), ("a < b <b", "a < b"), ("&amp", "&"), ("</p></div>text", "text"), ("<!-- a", ""), ("<script>x", ""), ("<p title='a>b'>T</p>", "T"), ("<p>a<p>b", "a\nb"), ("x" * 300_000, "x" * 300_000)])
def test_odd_pages(page, text):
    assert html.extracted(page, {})[0] == text


def test_bpe_is_the_librarys(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = registry.tokenizer_path()
    codec = bpe.Codec(path)
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " \x1c\x1d x\x1f", "　 a ​  b\x85\xa0c", "don't I'LL we'll", "  \n\n  x   ", "\U0001f600\U0001f600 é́ ١٢٣ Ⅷ ²", "x" * 5000, "\x00\x01", "日本語テキスト"]
    texts += ["".join(rng.choice("aeiou stn'.\n\t1é漢") for _ in range(200)) for _ in range(40)]
    encode = codec.encoder()
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert encode(t) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False) == t
    shared = bpe.shared(spark.range(1), path)
    df = spark.createDataFrame([(1, "a b", "clash"), (2, None, ""), (3, "", ""), (1, "a b", "")], "doc_id long, text string, token_ids string")
    got = bpe.decoded(bpe.encoded(df, "text", shared), "token_ids", shared, "back").collect()
    assert [(r["doc_id"], r["back"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, "a b"), (1, "a b"), (2, ""), (3, "")]
    assert bpe.encoded(df.where("false"), "text", shared).count() == 0
    long = "né " * 100_000 + "x" * 50_000
    for text in (long, "ab" * 3_000):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids
    for bad in ([-1], [1 << 30], [5, None]):
        with pytest.raises(ValueError):
            codec.decode(bad)


def test_shards_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice(["x", "é", None, ""]), "clash") for i in range(300)] + [(None, "b", "x", ""), (5, "b", "t", ""), (5, "b", "t", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, shard string")
    got = shard.interleaved(df, 7).toPandas()
    assert len(got) == 303 and sorted(got["position"]) == list(range(303))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    mixture = got.assign(source=got["source"].fillna("-")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2
    known = got[got["row_id"].notna() & (got["row_id"] != 5)]
    text = {r[0]: r[2] or "" for r in rows}
    assert all(zlib.crc32(text[i].encode()) == c and len(text[i].encode()) + 1 == s for i, c, s in zip(known["row_id"], known["text_crc32"], known["size"]))
    # The order within sources is the seeded shuffle, and fractions rise along positions.
    got["rank"] = got.sort_values("position").groupby(got["source"].fillna("-")).cumcount()
    fraction = (2 * got["rank"] + 1) / (2 * got.groupby(got["source"].fillna("-"))["rank"].transform("size"))
    assert fraction[got.sort_values("position").index].is_monotonic_increasing
    assert shard.interleaved(df.where("false"), 7).count() == 0
    assert sorted(r["shard"] for r in shard.interleaved(df.limit(2), 7).collect()) == [0, 3]


def test_rows_alike_in_all_are_sharded_like_others(spark):
    df = spark.createDataFrame([(1, "hot", "x")] * 200 + [(2, None, None)] * 30 + [(k, "b", "y") for k in range(40)], "doc_id long, source string, text string")
    got = shard.interleaved(df, 8).toPandas()
    assert sorted(got["position"]) == list(range(270)) and got.groupby("shard").size().between(33, 34).all()
    mixture = got.assign(source=got["source"].fillna("-")).groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mixture.max(axis=1) - mixture.min(axis=1)).max() <= 2


def test_words_and_shingles_against_plain_python():
    import pyarrow as pa

    rng = random.Random(6)
    texts = ["", " ", "one", "One oNE one", None] + ["".join(rng.choice("aAbé \n\t") for _ in range(rng.randrange(300))) for _ in range(50)]
    words = Words(Texts(pa.array(["skipped", *texts])[1:]))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    seen = {}
    for k, w in enumerate(split):
        for word, h in zip(w, words.hashes[words.at[k] : words.at[k + 1]].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    hashes, at = words.shingles(3)
    seen = {}
    for k, w in enumerate(split):
        want = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] * bool(w)
        for s, h in zip(want, hashes[at[k] : at[k + 1]].tolist(), strict=True):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chat_query_hashes_what_was_asked(spark, sf):
    r = registry.op2_chat_format(spark, sf).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["loss_chars"] == len(text)


def test_words_encoded_side_by_side(monkeypatch):
    codec = bpe.Codec(registry.tokenizer_path())
    rng = random.Random(8)
    words = list({"".join(rng.choice("abeinorst ADE\u00e9\u6f22\U0001f600") for _ in range(rng.randrange(1, 65))) for _ in range(3_000)} | {"a", "\0", "\0\0", "\U0001f600" * 64, "x" * 64})
    ids, at = codec.queued(words)
    assert [tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])] == [codec.word(w) for w in words]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)  # words grow old, are met again and are forgotten
    encode, texts = codec.batch_encoder(), [" ".join(rng.choices(words[:200], k=30)) + "y" * 100 + "<|endoftext|>" for _ in range(60)]
    want = [bpe.Codec(registry.tokenizer_path()).encoder()(t) for t in texts[:3]]
    got = []
    for k in range(0, 60, 4):
        ids, at = encode(texts[k : k + 4])
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got[:3] == want and [codec.decode(x) for x in got] == texts
