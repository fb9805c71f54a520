import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeweave.operators import distance, encode, partition, quantiles, resample, seq, tree
from typeweave.operators.components import components
from typeweave.operators.offsets import ranked
from typeweave.sources import newick


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def brute_ari(a, b):
    n = len(a)
    same = lambda x: {(i, j) for i in range(n) for j in range(i) if x[i] == x[j]}
    sa, sb = same(a), same(b)
    total = n * (n - 1) / 2
    expected, mean = len(sa) * len(sb) / total, (len(sa) + len(sb)) / 2
    return 1.0 if mean == expected else (len(sa & sb) - expected) / (mean - expected)


def test_agreement_against_pairs_and_refinement(spark):
    rng = random.Random(1)
    for trial in range(3):
        a = [rng.choice("xyz") for _ in range(40)]
        b = [x + rng.choice("12") for x in a]
        c = [rng.choice("uv") for _ in range(40)]
        df = rows(spark, list(zip(a, b, c)), "a string, b string, c string")
        one = partition.agreement(df, "a", "c").first()
        assert one["ari"] == pytest.approx(brute_ari(a, c), abs=1e-7)
        assert partition.agreement(df, "c", "a").first()["ari"] == pytest.approx(one["ari"], abs=1e-9)
        refined = partition.agreement(df, "b", "a").first()
        assert refined["wallace"] == 1 and refined["adj_wallace"] == 1


def test_agreement_leaves_out_missing_labels_and_is_null_without_rows(spark):
    df = rows(spark, [("x", "u"), ("x", None), (None, "u"), ("y", "v")], "a string, b string")
    assert partition.agreement(df, "a", "b").first()["n"] == 2
    empty = partition.agreement(df.where("false"), "a", "b").collect()
    assert all(r["ari"] in (None, 1.0) and not r["n"] for r in empty)


def test_simpson_known_values_and_undefined(spark):
    # 602 labels in eight classes.
    sizes = {"A": 378, "F": 61, "Basal": 37, "B": 33, "C": 33, "E": 22, "D": 19, "L": 19}
    df = rows(spark, [(k,) for k, n in sizes.items() for _ in range(n)], "label string")
    r = partition.simpson(df, "label").first()
    assert (r["simpson"], r["lo"], r["hi"]) == pytest.approx((0.5833190530, 0.5396101143, 0.6270279916), abs=1e-7)
    assert (r["types"], r["n"]) == (8, 602)
    assert partition.simpson(rows(spark, [("x",)], "label string"), "label").first()["simpson"] is None


@pytest.mark.parametrize("k, n, lo, hi", [(327, 336, 0.9498846987, 0.9858453591), (130, 130, 0.9712974143, 1), (0, 10, 0, 0.2775401688)])
def test_wilson(spark, k, n, lo, hi):
    low, high = partition.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r["l"], r["h"]) == pytest.approx((lo, hi), abs=1e-7)


def test_wilson_of_nothing_is_null(spark):
    low, high = partition.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (None, None)


def test_confusion_counts_and_undefined_rates(spark):
    df = rows(spark, [(True, False), (True, False), (False, False), (None, True)], "p boolean, t boolean")
    r = partition.confusion(df, F.col("p"), F.col("t")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (0, 2, 0, 1)
    assert r["sens"] is None and r["ppv"] == 0


def test_ranked_is_gapless_with_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 10).alias("v"), F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), "id")
    out = ranked(df, ["g"], F.floor(F.col("id") / 100), ["id"], "r").toPandas()
    for _, part in out.groupby("g"):
        part = part.sort_values("id")
        assert part["r"].tolist() == list(range(len(part)))


def test_sequence_types_missing_loci_and_novelty(spark):
    entities = rows(spark, [(i,) for i in range(1, 6)], "entity long")
    long = rows(
        spark,
        [(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x"), (4, "a", "z"), (4, "b", "y"), (3, "b", "")],
        "entity long, locus string, value string",
    )
    got = {r["entity"]: tuple(r)[1:] for r in encode.sequence_types(entities, long, ["a", "b"]).collect()}
    assert got == {
        1: (1, False, False, ""), 2: (1, False, False, ""), 3: (None, None, True, "b"), 4: (2, True, False, ""), 5: (None, None, True, "a;b"),
    }


def test_dictionaries_break_ties_by_first_appearance(spark):
    long = rows(spark, [(1, "a", "q"), (2, "a", "p"), (3, "a", "r"), (4, "a", "r"), (5, "a", None)], "entity long, locus string, value string")
    by_count = {r["value"]: r["code"] for r in encode.frequency_dictionary(long, "entity").collect()}
    by_first = {r["value"]: r["code"] for r in encode.first_seen_dictionary(long, "entity").collect()}
    assert by_count == {"r": 1, "q": 2, "p": 3} and by_first == {"q": 1, "p": 2, "r": 3}


def test_remap_skips_maps_and_raises(spark):
    local = rows(spark, [(1, 10), (2, 10), (3, 11), (4, 12)], "entity long, local_label long")
    good = rows(spark, [("A", 1, "1 ; 2;nan"), ("B", 2, "3"), ("C", 3, "99")], "label string, order_no int, reps string")
    assert {tuple(r) for r in encode.remapped(local, good).collect()} == {(10, "A", False), (11, "B", False)}
    bad = rows(spark, [("A", 1, "1;3")], "label string, order_no int, reps string")
    assert encode.remapped(local, bad, checked=False).first()["conflict"]
    with pytest.raises(Exception, match="several local labels"):
        encode.remapped(local, bad).collect()


def test_anchor_distance_at_the_cut_and_missing_calls(spark):
    a = [1] * 30
    profiles = rows(spark, [(0, a), (1, [2] * 25 + [1] * 5), (2, [2] * 26 + [1] * 4), (3, [None] * 30)], "k int, p array<int>")
    got = {r["k"]: (r["distance"], r["compared"], r["member"]) for r in distance.distance_to_anchor(profiles, profiles.where("k = 0"), "k", "p", 25).collect()}
    assert got == {0: (0, 30, True), 1: (25, 30, True), 2: (26, 30, False), 3: (0, 0, True)}


def brute_complexes(profiles):
    names = sorted(profiles)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in names:
        for j in names:
            if sum(x is None or y is None or x != y for x, y in zip(profiles[i], profiles[j])) <= 1:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    order = {}
    return {n: order.setdefault(find(n), len(order) + 1) for n in names}


def test_complexes_with_missing_values(spark):
    rng = random.Random(5)
    for _ in range(3):
        found = {i: tuple(rng.choice(["a", "b", "c", None]) for _ in range(4)) for i in range(1, 30)}
        found = {k: v for k, v in found.items() if v not in {found[j] for j in range(1, k) if j in found}}
        df = rows(spark, [(k, *v) for k, v in found.items()], "k long, p string, q string, r string, s string")
        got = {r["k"]: r["complex"] for r in distance.complexes(df, "k", ["p", "q", "r", "s"]).collect()}
        # A profile with a missing value differs from itself there; complexes are those of different profiles.
        assert got == brute_complexes(found)


def test_components_chain_star_loops_and_nulls(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(101, 160)] + [(7, 7), (200, 200), (None, 3), (39, 40)]
    got = {r["node"]: r["component"] for r in components(rows(spark, edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[j] == 100 for j in range(100, 160)) and got[200] == 200
    assert components(rows(spark, [], "a long, b long")).count() == 0


def test_n50_half_exactly_and_quality(spark):
    df = rows(spark, [("a", "G" * 5), ("a", "c" * 3), ("a", "AT"), ("b", "")], "k string, s string")
    got = {r["k"]: r for r in seq.quality(df, "k", "s", 10, 10, 5).collect()}
    assert (got["a"]["n50"], got["a"]["gc_pct"], got["a"]["status"]) == (5, 80.0, "PASS")
    assert (got["b"]["n50"], got["b"]["gc_pct"], got["b"]["status"]) == (0, 0.0, "FAIL")


def test_best_hit_bounds_and_ties(spark):
    hits = rows(spark, [("q", 1, 50, 9.0), ("q", 2, 150, 9.0), ("q", 3, 49, 99.0), ("z", 1, 100, 0.0)], "q string, pos int, len int, score double")
    got = seq.best_hit(hits, "q", F.col("len"), F.lit(100.0), "score", "pos").collect()
    assert [(r["q"], r["pos"]) for r in got] == [("q", 1)]


def test_slice_on_the_other_strand(spark):
    r = spark.range(1).select(seq.slice_with_strand(F.lit("AACGT"), F.lit(4), F.lit(2)).alias("x"), seq.slice_with_strand(F.lit("AACGT"), F.lit(2), F.lit(4)).alias("y")).first()
    assert tuple(r) == ("CGT", "ACG")


TREE_A = "((A:1,B:2)90:1,(C:1,(D:1,E:1)70:2)80:1,F:3);"
TREE_B = "((A:1,C:2)95:1,(B:1,(D:1,E:1)60:2)80:1,F:3);"


def node_tables(spark, **trees):
    return newick.nodes_of(rows(spark, list(trees.items()), "tree string, newick string")).cache()


def test_newick_names_supports_and_lengths():
    nodes = newick.parse("('a b':1.5,(c,d)77:2)root;")
    assert [n["label"] for n in nodes] == ["root", "a b", "77", "c", "d"]
    assert nodes[4]["root_dist"] == 2.0 and [(n["last"], n["depth"]) for n in nodes] == [(4, 0), (1, 1), (4, 1), (3, 2), (4, 2)]
    with pytest.raises(ValueError):
        newick.parse("((a,b);")


def test_tree_distances_splits_and_comparison(spark):
    nodes = node_tables(spark, a=TREE_A, b=TREE_B, c=TREE_A)
    leaf = tree.leaves(nodes)
    d = {(r["tree"], r["a"], r["b"]): r["distance"] for r in tree.patristic(nodes, leaf).collect()}
    assert d["a", "A", "B"] == 3 and d["a", "D", "E"] == 2 and d["a", "A", "F"] == 5 and d["a", "B", "D"] == 7
    total = {(r["tree"], r["name"]): r["total"] for r in tree.total_distances(nodes, leaf).collect()}
    for (t, x), s in total.items():
        assert s == pytest.approx(sum(v for (u, a, b), v in d.items() if u == t and x in (a, b)))
    found = tree.splits(nodes, leaf).cache()
    same, other = tree.robinson_foulds(found, "a", "c").first(), tree.robinson_foulds(found, "a", "b").first()
    assert (same["rf"], same["nrf"], same["shared"]) == (0, 0.0, 3)
    assert (other["rf"], other["shared"]) == (4, 1)
    assert tree.clustering_information(found, "a", "c").first()["cid"] == 0
    assert 0 < tree.clustering_information(found, "a", "b").first()["cid"] < 1


def test_support_resolution_and_pruning(spark):
    nodes = node_tables(spark, a=TREE_A)
    s = tree.support(nodes).first()
    assert (s["n"], s["median"], s["over_70"]) == (3, 80.0, 100.0)
    r = tree.resolution(nodes).first()
    assert (r["internal"], r["most"], r["index"]) == (4, 5, 80.0)
    kept = rows(spark, [("A",), ("D",), ("E",)], "name string")
    small = tree.pruned(nodes, kept)
    assert small.count() == 5 and tree.resolution(small).first()["index"] == 100.0
    d = {(x["a"], x["b"]): x["distance"] for x in tree.patristic(small, tree.leaves(small)).collect()}
    assert d == {("A", "D"): 6.0, ("A", "E"): 6.0, ("D", "E"): 2.0}


def test_four_points_and_symmetry():
    nodes = newick.parse(TREE_A)
    leaf = [n for n in nodes if n["leaf"]]
    depth = {i: n["root_dist"] for i, n in enumerate(nodes)}

    at = {id(n): i for i, n in enumerate(nodes)}

    def d(x, y):
        common = [i for i, n in enumerate(nodes) if all(i <= at[id(z)] <= n["last"] for z in (x, y))]
        return x["root_dist"] + y["root_dist"] - 2 * depth[common[-1]]

    for a in leaf:
        for b in leaf:
            for c in leaf:
                for e in leaf:
                    s = sorted((d(a, b) + d(c, e), d(a, c) + d(b, e), d(a, e) + d(b, c)))
                    assert math.isclose(s[1], s[2])


def test_mantel_of_itself_and_without_variance(spark):
    rng = np.random.default_rng(3)
    pairs = [(f"n{i}", f"n{j}", float(rng.random()), 1.0) for i in range(8) for j in range(i + 1, 8)]
    df = rows(spark, pairs, "a string, b string, x double, y double").withColumn("z", 2 * F.col("x"))
    assert tree.mantel(df, "x", "z").first()["r"] == 1.0
    assert tree.mantel(df, "x", "y").first()["r"] is None
    p = tree.mantel_permutations(df, "x", "z", 99).first()
    assert p["r"] == 1.0 and p["p"] <= 0.05 and p["permutations"] == 99


def test_permutations_in_strips_against_plain_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 7, 20
    x, y = (np.triu(rng.integers(0, 9, (n, n)), 1).astype(float) for _ in range(2))
    data = [(f"n{i}", f"n{j}", float(x[i, j]), float(y[i, j])) for i in range(n) for j in range(i + 1, n)]
    df = rows(spark, data, "a string, b string, x double, y double")
    at = np.triu_indices(n, 1)

    def r_of(k):
        order = tree.permutation(k, n, 42)
        assert sorted(order) == list(range(n))
        return np.corrcoef((x + x.T)[np.ix_(order, order)][at], y[at])[0, 1]

    seen = r_of(0)
    as_large = sum(r_of(k) >= seen - 1e-12 for k in range(1, m + 1))
    for cells, together in ((2_000_000, 500), (2 * n, 6)):  # one strip, and strips of two names
        monkeypatch.setattr(tree, "STRIP_CELLS", cells)
        monkeypatch.setattr(tree, "PERMUTATIONS_TOGETHER", together)
        got = tree.mantel_permutations(df, "x", "y", m).first()
        assert got["r"] == pytest.approx(seen, abs=1e-8) and got["p"] == pytest.approx((as_large + 1) / (m + 1)) and got["permutations"] == m
    got = tree.mantel_permutations(df.withColumn("y", F.lit(1.0)), "x", "y", 5).first()
    assert got["r"] is None and got["p"] is None
    assert tree.mantel_permutations(df.where("false"), "x", "y", 5).count() == 0


def random_newick(rng, names):
    """A tree with inner nodes of one to four children."""
    if len(names) == 1:
        text = f"{names[0]}:{rng.randrange(1, 9)}"
        return f"({text}):{rng.randrange(1, 5)}" if rng.random() < 0.2 else text
    cuts = sorted(rng.sample(range(1, len(names)), min(len(names) - 1, rng.randrange(1, 4))))
    parts = [names[a:b] for a, b in zip([0, *cuts], [*cuts, len(names)])]
    return f"({','.join(random_newick(rng, p) for p in parts)}){rng.randrange(100)}:{rng.randrange(1, 9)}"


def test_random_trees_against_plain_walks(spark, monkeypatch):
    """Distances, splits and pruning of whole trees and of some of their leaves, in blocks of three leaves."""
    monkeypatch.setattr(tree, "BLOCK_LEAVES", 3)
    rng = random.Random(6)
    texts = {}
    for t in range(6):
        names = [f"n{k:02d}" for k in range(rng.randrange(2, 22))]
        rng.shuffle(names)
        texts[f"t{t}"] = random_newick(rng, names) + ";"
    texts["deep"] = "(" * 400 + "n00:1" + "".join(f",m{k}:1):1" for k in range(400)) + ";"
    nodes = node_tables(spark, **texts)
    only = rows(spark, [(f"n{k:02d}",) for k in range(0, 22, 3)] + [(f"m{k}",) for k in range(0, 400, 37)], "name string")
    wanted = {r["name"] for r in only.collect()}
    whole, some = tree.leaves(nodes), tree.leaves(nodes, only)
    got = [{(r["tree"], r["a"], r["b"]): r["distance"] for r in tree.patristic(nodes, x).collect()} for x in (whole, some)]
    totals = [{(r["tree"], r["name"]): r["total"] for r in tree.total_distances(nodes, x).collect()} for x in (whole, some)]
    small = tree.pruned(nodes, only).cache()
    kept = {(r["tree"], r["node"]): r for r in small.collect()}
    found = {(r["tree"], r["node"]): (r["size"], r["p"]) for r in tree.splits(nodes, whole).collect()}
    again = {(r["tree"], r["a"], r["b"]): r["distance"] for r in tree.patristic(small, tree.leaves(small)).collect()}
    assert again == pytest.approx(got[1])
    for t, text in texts.items():
        plain = newick.parse(text)
        up = lambda i: [] if i is None else [*up(plain[i]["parent"]), i]  # noqa: B023, E731
        paths = {i: up(i) for i in range(len(plain))} if t != "deep" else {i: [j for j in range(i + 1) if plain[j]["last"] >= i] for i in range(len(plain))}
        leaf = {n["label"]: i for i, n in enumerate(plain) if n["leaf"]}
        for want, total, chosen in zip(got, totals, (leaf, {k: v for k, v in leaf.items() if k in wanted})):
            sums = dict.fromkeys(chosen, 0.0)
            for a, i in chosen.items():
                for b, j in chosen.items():
                    if a < b:
                        meet = [p for p, q in zip(paths[i], paths[j]) if p == q][-1]
                        d = plain[i]["root_dist"] + plain[j]["root_dist"] - 2 * plain[meet]["root_dist"]
                        assert want[t, a, b] == d
                        sums[a] += d
                        sums[b] += d
            assert {x: total[t, x] for x in sums} == pytest.approx(sums)
        under = {i: {a for a, j in leaf.items() if i in paths[j]} for i in range(len(plain))}
        least = min(x["name"] for x in whole.collect())
        splits = {(t, i): (len(leaf) - len(x) if least in x else len(x), len(x) / len(leaf)) for i, x in under.items() if not plain[i]["leaf"] and 1 < len(x) < len(leaf) - 1}
        assert {k: v for k, v in found.items() if k[0] == t} == splits
        below = {i: x & wanted for i, x in under.items()}
        children = {i: [j for j in range(len(plain)) if plain[j]["parent"] == i and below[j]] for i in under}
        stays = {i for i in under if below[i] and (plain[i]["leaf"] or len(children[i]) > 1)}
        assert {i for u, i in kept if u == t} == stays
        order = sorted(stays)
        for i in stays:
            r, above = kept[t, i], [p for p in paths[i][:-1] if p in stays]
            assert r["parent"] == (above[-1] if above else None) and r["depth"] == len(above)
            assert r["first"] == order.index(i) and r["last"] == order.index(i) + sum(plain[i]["last"] >= j > i for j in stays)
            assert r["length"] == (plain[i]["root_dist"] - plain[above[-1]]["root_dist"] if above else None)


def test_distances_of_a_large_tree_in_blocks(spark, monkeypatch):
    nodes = node_tables(spark, a=TREE_A, b=TREE_B)
    whole = tree.patristic(nodes, tree.leaves(nodes)).collect()
    monkeypatch.setattr(tree, "BLOCK_LEAVES", 2)
    assert sorted(map(tuple, tree.patristic(nodes, tree.leaves(nodes)).collect())) == sorted(map(tuple, whole)) and len(whole) == 30


def plain_draws(cells, replicates):
    """Draws of each replicate by recursive halving of the cells, with the uniform number's quantile found by exact fractions' sums."""
    depth = max(len(cells) - 1, 0).bit_length()

    def quantile(t, p, u):
        upto = 0.0
        for k in range(t + 1):
            upto += math.comb(t, k) * p**k * (1 - p) ** (t - k)
            if upto >= u:
                return k
        return t

    def split(rep, node, level, held, t):
        if level == depth:
            return [(held[0][0], t)] if held and t else []
        half = 1 << (depth - level - 1)
        base = (node << (depth - level)) - (1 << depth)
        left, right = [h for h in held if h[0] < base + half], [h for h in held if h[0] >= base + half]
        a, b = sum(n for _, n in left), sum(n for _, n in right)
        k = 0 if t == 0 or a == 0 else t if b == 0 else quantile(t, a / (a + b), float(resample.uniform(np.array([rep]), np.array([node]))[0]))
        return split(rep, 2 * node, level + 1, left, k) + split(rep, 2 * node + 1, level + 1, right, t - k)

    held = list(enumerate(cells))
    return [split(rep, 1, 0, held, sum(cells)) for rep in range(replicates)]


@pytest.mark.parametrize("bits, together", [(12, 125), (2, 4)])
def test_resampling_by_cells_against_plain_halving(bits, together, spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BITS", bits)
    monkeypatch.setattr(resample, "TOGETHER", together)
    rng = random.Random(10)
    data = {g: sorted((rng.choice("vwxyz"), rng.choice("abcdef")) for _ in range(n)) for g, n in (("one", 70), ("two", 5), ("three", 1))}
    df = rows(spark, [(g, a, b) for g, x in data.items() for a, b in x], "g string, a string, b string")
    cells = partition.contingency(df, "a", "b", ["g"])
    got = {}
    for r in resample.resampled(cells, ["g"], 9).collect():
        got.setdefault((r["g"], r["rep"]), []).append((r["a"], r["b"], r["n"]))
    aris = []
    for g, x in data.items():
        names = sorted(set(x))
        first = {c: min(k for k, cell in enumerate(names) if cell[s] == c) for s in (0, 1) for c in {cell[s] for cell in names}}
        for rep, drawn in enumerate(plain_draws([x.count(c) for c in names], 9)):
            assert sorted(got[g, rep]) == sorted((first[names[k][0]], first[names[k][1]], n) for k, n in drawn)
            assert sum(n for _, n in drawn) == len(x)
            if g == "one":
                pairs = [names[k] for k, n in drawn for _ in range(n)]
                aris.append(brute_ari([a for a, _ in pairs], [b for _, b in pairs]))
    limits = {r["g"]: r for r in resample.intervals(cells, ["g"], partition.statistics_of, 9).where("statistic = 'ari'").collect()}
    assert (limits["one"]["lo"], limits["one"]["hi"]) == (pytest.approx(np.quantile(aris, 0.025), abs=1e-7), pytest.approx(np.quantile(aris, 0.975), abs=1e-7))


def test_draws_have_a_binomials_mean_and_spread():
    for trials, part in ((9, 0.3), (3_000, 0.01), (10**9, 0.25)):
        got = resample.binomial(np.full(4_000, trials), np.full(4_000, part), resample.uniform(np.arange(4_000), np.full(4_000, 7)))
        sd = math.sqrt(trials * part * (1 - part))
        assert abs(got.mean() - trials * part) < 4 * sd / math.sqrt(4_000) and abs(got.std() / sd - 1) < 0.05


def test_statistics_of_cells_agree_with_those_of_rows(spark):
    rng = random.Random(11)
    df = rows(spark, [(rng.choice("xyz"), rng.choice("uvw")) for _ in range(80)] + [(None, "u")], "a string, b string")
    got = partition.statistics_of(partition.contingency(df, "a", "b")).first()
    want = partition.agreement(df, "a", "b").first()
    assert (got["ari"], got["adj_wallace"]) == (pytest.approx(want["ari"], abs=1e-8), pytest.approx(want["adj_wallace"], abs=1e-8))
    assert got["ami"] == pytest.approx(partition.adjusted_mutual_information(df, "a", "b").first()["ami"], abs=1e-6)
    assert got["simpson_one"] == pytest.approx(partition.simpson(df.where("a IS NOT NULL"), "a").first()["simpson"], abs=1e-8)


def test_pairs_of_more_than_64_bits(spark):
    """Cells of up to 4e9 rows: all statistics of pairs stay exact."""
    n = [4 * 10**9, 4 * 10**9 + 1, 7]
    cells = rows(spark, [("a", "x", n[0]), ("a", "y", n[1]), ("b", "x", n[2])], "a string, b string, n long")
    two = lambda k: k * (k - 1) // 2
    got = partition.pair_counts(cells).first()
    assert (int(got["both"]), int(got["in_a"]), int(got["in_b"]), got["n"]) == (sum(map(two, n)), two(n[0] + n[1]) + two(n[2]), two(n[0] + n[2]) + two(n[1]), sum(n))
    value = partition.agreement_of(cells).first()
    assert value["wallace"] == pytest.approx(sum(map(two, n)) / (two(n[0] + n[1]) + two(n[2])))
    assert all(v is not None for v in partition.statistics_of(cells).first())


def test_types_complexes_and_numbers_of_accessions(spark):
    long = [(e, l, v) for e, p in {"SRR9": "aab", "ERR2": "aab", "GCA_7.1": "aac", "SRR10": "zzz", "DRR1": "q b"}.items() for l, v in zip(["m", "k", "c"], p) if v != " "]
    df = rows(spark, long, "entity string, locus string, value string")
    entities = rows(spark, [(e,) for e in ("SRR9", "ERR2", "GCA_7.1", "SRR10", "DRR1", "none")], "entity string")
    got = {r["entity"]: (r["st"], r["is_novel"], r["missing_loci"]) for r in encode.sequence_types(entities, df, ["m", "k", "c"]).collect()}
    assert got == {"ERR2": (1, False, ""), "SRR9": (1, False, ""), "GCA_7.1": (2, True, ""), "SRR10": (3, True, ""), "DRR1": (None, None, "k"), "none": (None, None, "m;k;c")}
    codes = {(r["locus"], r["value"]): r["code"] for r in encode.complete_dictionary(df, ["m", "k", "c"]).collect()}
    assert codes == {("m", "a"): 1, ("m", "z"): 2, ("k", "a"): 1, ("k", "z"): 2, ("c", "b"): 1, ("c", "c"): 2, ("c", "z"): 3}
    wide = rows(spark, [("SRR9", "a", "a", "b"), ("GCA_7.1", "a", "a", "c"), ("SRR10", "z", "z", "z")], "id string, m string, k string, c string")
    found = {r["id"]: r["complex"] for r in distance.complexes(wide, "id", ["m", "k", "c"]).collect()}
    assert found == {"GCA_7.1": 1, "SRR9": 1, "SRR10": 2}
    mapping = rows(spark, [("x", "T1"), ("y", "T2")], "local_label string, label string")
    named = encode.relabelled(rows(spark, [("x", 1), ("w", 2), (None, 3)], "label string, n int"), mapping, "label")
    assert sorted(map(tuple, named.collect()), key=lambda r: r[1]) == [("T1", 1), (None, 2), (None, 3)] and named.columns == ["label", "n"]


def test_ranks_of_a_hot_group(spark):
    from typeweave.operators.offsets import placed

    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.random(), str(k)) for k in range(400)]
    got = placed(rows(spark, data, "g string, v double, k string"), ["g"], [F.desc("v"), F.col("k")], "place").collect()
    want = {}
    for g, v, k in sorted(data, key=lambda r: (-r[1], r[2])):
        want[k] = sum(1 for h, w, j in data if h == g and (-w, j) < (-v, k))
    assert {r["k"]: r["place"] for r in got} == want


def test_components_of_a_long_path(spark):
    edges = rows(spark, [(k, k + 1) for k in range(300)] + [(1000, 1001)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_no_local_folder_on_a_cluster():
    from typeweave.sources.tables import shared_folder

    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError):
        shared_folder(Session)


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.integers(0, 99).map(lambda i: f"t{i}:1"), lambda x: st.lists(x, min_size=2, max_size=3).map(lambda v: "(" + ",".join(v) + "):1"), max_leaves=12))
def test_newick_keeps_every_leaf(text):
    nodes = newick.parse(text + ";")
    assert sum(n["leaf"] for n in nodes) == text.count("t")
    assert all(n["parent"] is None or n["parent"] < i <= nodes[n["parent"]]["last"] for i, n in enumerate(nodes))


def test_mantel_query_has_the_references_permutations(spark, sf):
    from typeweave.jobs.trees import q_mantel_perm

    got = q_mantel_perm(spark, sf).first()
    assert got["permutations"] == 9_999 and 1 / 10_000 <= got["p"] <= 1


def test_informative_sites_are_counted_to_the_end(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("acgt"), size)) for size in rng.integers(60, 200, 12)]
    got = {r["site"]: (r["states"], r["informative"]) for r in seq.informative_sites(rows(spark, [(t,) for t in texts], "t string"), "t").collect()}
    for site in range(max(map(len, texts))):
        column = [t[site].upper() for t in texts if site < len(t)]
        assert got.pop(site) == (len(set(column)), sum(column.count(c) >= 2 for c in set(column)) >= 2)
    assert not got


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    data = [("hot", float(v)) for v in rng.integers(0, 40, 500)] + [("one", 3.5)] + [("few", float(v)) for v in rng.random(4)] + [("none", None), (None, 1.0)]
    got = {r["k"]: r for r in quantiles.exact_quantiles(rows(spark, data, "k string, v double"), ["k"], "v", [0.0, 0.025, 0.5, 0.975, 1.0]).collect()}
    assert set(got) == {"hot", "one", "few"}
    for k, r in got.items():
        values = [v for x, v in data if x == k]
        assert r["n"] == len(values) and r["quantiles"] == pytest.approx(list(np.quantile(values, [0.0, 0.025, 0.5, 0.975, 1.0])))
    whole = quantiles.exact_quantiles(rows(spark, data, "k string, v double"), [], "v", [0.5]).first()
    values = [v for _, v in data if v is not None]
    assert whole["n"] == len(values) and whole["quantiles"] == pytest.approx([np.quantile(values, 0.5)])


def test_newick_nodes_are_closed_with_their_way_alone():
    text = "(" * 5_000 + "x" + ",y)" * 5_000 + ";"
    seen = [(node, parent, last, depth) for node, parent, _, _, _, last, depth in newick.closed_nodes(text)]
    assert len(seen) == 10_001 and seen[0] == (5_000, 4_999, 5_000, 5_000) and seen[-1] == (0, None, 10_000, 0)
    assert [(n["label"], n["leaf"], n["length"]) for n in newick.parse("(,b:1[note],(c)d:2)e;")] == [("e", False, None), ("", True, None), ("b", True, 1.0), ("d", False, 2.0), ("c", True, None)]
    for broken in ("(a,b", "a,b;", "(a,b));"):
        with pytest.raises(ValueError):
            newick.parse(broken)


def test_mantel_of_leaves_against_all_pairs(spark):
    """Trees with unary nodes, missing lengths and chains; values that tie or lack; one value alone, leaves at one distance, and two leaves."""
    rng = random.Random(8)
    names = [f"n{k:02d}" for k in range(17)]
    rng.shuffle(names)
    chain = "(" * 12 + "n00:1" + "".join(f",m{k:02d}):{k % 3}" for k in range(12)) + ";"
    for text, values in (
        (random_newick(rng, names) + ";", {n: rng.choice([1.5, 2.25, 7.0, None]) for n in names} | {"elsewhere": 3.0}),
        (chain, {n: rng.random() for n in ["n00", *(f"m{k:02d}" for k in range(12))]}),
        (chain, {n: 4.7 for n in ["n00", *(f"m{k:02d}" for k in range(12))]}),
        ("(a:0.1,b:0.1,c:0.1,d:0.1);", {"a": 1.0, "b": 2.0, "c": 4.0, "d": 4.5}),
        ("(a:1,b:2);", {"a": 1.0, "b": 2.0}),
    ):
        nodes = node_tables(spark, one=text)
        held = rows(spark, list(values.items()), "name string, v double")
        one, two = held.withColumnsRenamed({"name": "a", "v": "va"}), held.withColumnsRenamed({"name": "b", "v": "vb"})
        pairs = tree.patristic(nodes, tree.leaves(nodes)).join(one, "a").join(two, "b").select("a", "b", "distance", F.abs(F.col("va") - F.col("vb")).alias("gap"))
        both = pairs.where("gap IS NOT NULL").toPandas()
        varies = len(both) and both.gap.std(ddof=0) > 0 and both.distance.std(ddof=0) > 1e-9
        got = tree.mantel_of_leaves(nodes, tree.leaves(nodes), held).first()
        assert got["pairs"] == pairs.count()
        assert got["r"] == pytest.approx(np.corrcoef(both.distance, both.gap)[0, 1], abs=1e-8) if varies else got["r"] is None
    assert tree.mantel_of_leaves(nodes, tree.leaves(nodes).where("false"), held).first().asDict() == {"r": None, "pairs": 0}


def test_permutations_of_leaves_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(tree, "LEAF_PERMUTATIONS_TOGETHER", 7)
    rng = random.Random(9)
    names = [f"n{k:02d}" for k in range(7)]
    nodes = node_tables(spark, one=random_newick(rng, names) + ";")
    held = rows(spark, [(n, float(rng.randrange(4))) for n in names], "name string, v double")
    one, two = held.withColumnsRenamed({"name": "a", "v": "va"}), held.withColumnsRenamed({"name": "b", "v": "vb"})
    pairs = tree.patristic(nodes, tree.leaves(nodes)).join(one, "a").join(two, "b").select("a", "b", "distance", F.abs(F.col("va") - F.col("vb")).alias("gap"))
    assert tree.mantel_permutations_of_leaves(nodes, tree.leaves(nodes), held, 60).first() == tree.mantel_permutations(pairs, "distance", "gap", 60).first()
    same = tree.mantel_permutations_of_leaves(nodes, tree.leaves(nodes), held.withColumn("v", F.lit(1.0)), 5).first()
    assert same["r"] is None and same["p"] is None and same["permutations"] == 5


def test_mantel_queries_make_no_pairs(spark, sf, monkeypatch):
    from typeweave.jobs import trees

    def none(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(tree, "patristic", none)
    monkeypatch.setattr(tree, "mantel_permutations", none)
    assert trees.q_mantel(spark, sf).first()["r"] == trees.q_mantel_perm(spark, sf).first()["r"]


def test_expected_information_costs_no_more_with_more_rows(monkeypatch):
    seen, logs_of = [], partition._log_factorials

    def counted(total):
        logs = logs_of(total)
        return lambda n: (seen.append(np.size(n)), logs(n))[1]

    monkeypatch.setattr(partition, "_log_factorials", counted)
    terms = {}
    for total in (40_000, 4_000_000):
        ones, others = np.array([total // 4, total - total // 4]), np.array([total // 3, total - total // 3])
        seen.clear()
        got = partition._expected_information(ones, np.array([1, 1]), others, np.array([1, 1]), total)
        terms[total] = sum(seen)
        want = 0.0  # every count within the same bounds
        for a in ones:
            for b in others:
                mean = a * b / total
                wide = 9 * math.sqrt(mean * (1 - a / total) * (1 - b / total)) + 12
                k = np.arange(math.floor(mean - wide), math.ceil(mean + wide) + 1)
                lg = logs_of(total)
                chance = np.exp(lg(a) + lg(b) + lg(total - a) + lg(total - b) - lg(np.int64(total)) - lg(k) - lg(a - k) - lg(b - k) - lg(total - a - b + k))
                want += float(np.sum(k / total * np.log(total * k / (a * b)) * chance))
        assert got == pytest.approx(want, abs=1e-11)
    assert terms[4_000_000] <= 1.1 * terms[40_000] < 2_000


def test_replicates_are_dealt_to_all_partitions(spark):
    """Rows of few bytes and long work aren't put together in one task."""
    cells = rows(spark, [("x", f"a{i}", f"b{j}", 3) for i in range(4) for j in range(3)], "g string, a string, b string, n bigint")
    values = partition.statistics_of(resample.resampled(cells, ["g"], 40), ["g", "rep"])
    assert values.count() == 40 and values.select(F.spark_partition_id()).distinct().count() == 4
