r"""Personal data by weak supervision, in DataFrame functions alone.

Patterns find candidate spans of each kind: emails, IP addresses, card numbers,
phone numbers, and secrets such as access tokens. Five labelers vote on every
candidate, or abstain: the strict pattern with its checks, a gazetteer (domain
endings, issuer and calling codes, key words), the words before it, its edges, and
its shape. Expectation-maximisation over the counts of vote patterns (at most
5 * 3**5 rows, whatever the corpus) estimates how reliable each labeler is and how
likely each candidate is personal. With these soft labels a naive Bayes classifier
over the span's features is trained, and it decides. Spans that pass the strict
pattern and its checks always stay.

Offsets count code points from 0, ends exclusive. Spans of one kind never
overlap; spans of different kinds may.

Defined results: a null text is an empty one and has no spans; very long texts are
searched whole, in time that grows with their length and spans; repeated rows are
searched one by one; without any candidate there is no model, and none is
needed; input columns named like results are replaced; an empty table gives no
rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over

#: In the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
LABELERS = ["strict", "gazetteer", "context", "edges", "shape"]
ROUNDS, SURE = 10, 0.5

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Leftmost matches. Possessive repeats match alike but can't recurse or backtrack on
#: long texts; the look-behinds only skip starts inside a run whose start has failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{20,}+",
}
#: A text without this has no match.
_NEEDS = {"email": "@", "phone": "+", "ip": None, "card": None, "secret": None}
_ENDINGS = "com org net edu gov info io dev app co uk de fr es it nl eu us ca au ch at be br in jp".split()
_CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 420".split()
_CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|credit|payment|account)\b",
    "phone": r"(?i)\b(phone|call|tel|mobile|fax|dial)\b",
    "secret": r"""[=:]\s*["']?$""",
}
_KEY_WORD = r"(?i)\b(token|secret|key|api|password|passwd|pwd|auth|bearer|credential)\b"
_LEFT = 32  # code points before a span that count as its context
_CHUNK, _PART = 256, 1024


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, even where the use stands in a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, add, zero: int = 0) -> Column:
    """For each element, ``add`` folded over those before it; chunked, so that long arrays aren't folded quadratically."""
    total = lambda a: F.aggregate(a, F.lit(zero), add)
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")

    def places(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), chunk(F.size(n) - 1)), lambda c: total(F.slice(n, c * _CHUNK + 1, _CHUNK)))
        offsets = _let(sums, lambda s: F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))))
        return _let(offsets, lambda o: F.transform(n, lambda _, i: add(F.get(o, chunk(i)), total(F.slice(n, chunk(i) * _CHUNK + 1, i % _CHUNK)))))

    return F.when(F.size(values) > 0, _let(values, places)).otherwise(F.array().cast("array<int>"))


def _cut(body: Column) -> Column:
    """The text in parts of _PART code points, so that a place in a long text is reached without counting from its start."""
    return F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{_PART}}}"), F.lit(0))


def _piece(parts: Column, start: Column, length: Column) -> Column:
    """So many code points of a text in parts."""
    first, last = F.floor(start / _PART).cast("int"), F.floor((start + length) / _PART).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start - first * _PART + 1, length)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _strict(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": F.when(n.between(16, 19), _luhn(_digits(hit))).otherwise(False),
        "phone": n.between(8, 15),
        "secret": hit.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32,64})$"),
    }[kind]


def _votes(kind: str, hit: Column, left: Column, right: Column) -> list[Column]:
    """1 for personal, 0 against, -1 to abstain; in the order of LABELERS."""
    gazetteer = {
        "email": F.substring_index(F.lower(hit), ".", -1).isin(_ENDINGS),
        "ip": ~hit.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."),
        "card": _digits(hit).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": hit.rlike(rf"^\+(?:{'|'.join(_CALLING)})(?![0-9]{{3}}$)"),
        "secret": left.rlike(_KEY_WORD),
    }[kind]
    shape = {
        "email": hit.rlike(r"^[^@]{2,64}@[^@]*[A-Za-z]"),
        "ip": ~hit.rlike(r"(?:^|\.)0[0-9]"),
        "card": ~_digits(hit).rlike(r"^([0-9])\1*$"),
        "phone": hit.rlike(r"[\x20().-]") | (F.length(_digits(hit)) >= 10),
        "secret": hit.rlike("[A-Za-z]") & hit.rlike("[0-9]"),
    }[kind]
    edges = ~left.rlike(r"[\p{L}0-9]$") & ~right.rlike(r"^[\p{L}0-9]")
    vote = lambda c: F.when(c, 1).otherwise(0)
    return [vote(_strict(kind, hit)), vote(gazetteer), F.when(left.rlike(_CUES[kind]), 1).otherwise(-1), vote(edges), vote(shape)]


def _features(kind: str, hit: Column, left: Column, right: Column, votes: list[Column]) -> Column:
    """Values of a few small sets, for the final classifier."""
    share = F.length(_digits(hit)) / F.length(hit)
    sort = lambda c: F.when(c == "", "none").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    values = {
        "length": F.least(F.floor(F.log2(F.length(hit))), F.lit(8)),
        "digits": F.floor(share * 4),
        "left": sort(F.substring(left, -1, 1)),
        "right": sort(F.substring(right, 1, 1)),
        **dict(zip(LABELERS, votes)),
    }
    return F.array(*(F.concat(F.lit(f"{kind} {name} "), v.cast("string")) for name, v in values.items()))


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Adds the array of candidate spans: kind, start, end, strict, votes, features."""
    body = F.coalesce(F.col(text), F.lit(""))
    digits = body.rlike("[0-9]")
    inner = unused(docs.columns, *(f"{x}_{kind}" for kind in KINDS for x in ("hits", "gaps")), "parts", "found")
    hits_of, gaps_of, (parts_of, found_of) = dict(zip(KINDS, inner[:-2:2])), dict(zip(KINDS, inner[1:-2:2])), inner[-2:]
    added = docs
    for kind in KINDS:
        may = digits if _NEEDS[kind] is None else F.contains(body, F.lit(_NEEDS[kind]))
        none = F.array().cast("array<string>")
        hits = F.when(may, F.regexp_extract_all(body, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
        gaps = F.when(may, F.split(body, PATTERNS[kind], -1)).otherwise(none)
        added = added.withColumns({hits_of[kind]: hits, gaps_of[kind]: gaps})
    some = F.greatest(*(F.size(hits_of[kind]) for kind in KINDS)) > 0
    added = added.withColumn(parts_of, F.when(some, _cut(body)).otherwise(F.array().cast("array<string>")))
    pieces = F.col(parts_of)

    def spans(kind: str) -> Column:
        hits, gaps = F.col(hits_of[kind]), F.col(gaps_of[kind])
        widths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

        def span(hit: Column, start: Column) -> Column:
            left = _piece(pieces, F.greatest(start - _LEFT, F.lit(0)), F.least(start, F.lit(_LEFT)))
            right = _piece(pieces, start + F.length(hit), F.lit(1))
            return _let(F.struct(left.alias("left"), right.alias("right")), lambda c: _let(
                F.array(*_votes(kind, hit, c["left"], c["right"])),
                lambda v: F.struct(
                    F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), (F.get(v, 0) == 1).alias("strict"),
                    v.alias("votes"), _features(kind, hit, c["left"], c["right"], [F.get(v, j) for j in range(len(LABELERS))]).alias("features"),
                ),
            ))

        starts = lambda upto: F.transform(hits, lambda hit, i: _let(F.get(upto, i) + F.length(F.get(gaps, i)), lambda s: span(hit, s)))
        return _let(_running(widths, lambda x, y: x + y), starts)

    return added.withColumn(found_of, F.concat(*(spans(kind) for kind in KINDS))).drop(*inner[:-1], out).withColumnRenamed(found_of, out)


def fitted(found: DataFrame, column: str = "candidates") -> dict[str, float]:
    """Log odds of each feature value; "" has the prior's. Empty if there are no candidates.

    ``found`` should be a written table: it is read twice.
    """
    each = found.select(F.explode(column).alias("c")).select("c.kind", "c.votes", "c.features")
    votes = [F.get("votes", i).alias(f"v{i}") for i in range(len(LABELERS))]
    patterns = handed_over(each.groupBy("kind", *votes).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    prior = {k: 0.5 for k in KINDS}
    yes, no = [0.8] * len(LABELERS), [0.2] * len(LABELERS)

    def posterior(vote) -> Column:
        odds = F.create_map(*(x for k, p in prior.items() for x in (F.lit(k), F.lit(log(p / (1 - p))))))[F.col("kind")]
        for j in range(len(LABELERS)):
            odds = odds + F.when(vote(j) == 1, log(yes[j] / no[j])).when(vote(j) == 0, log((1 - yes[j]) / (1 - no[j]))).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    for _ in range(ROUNDS):
        p, n = posterior(lambda j: F.col(f"v{j}")), F.col("n")
        sums = [F.sum(n).alias("all")]
        for j in range(len(LABELERS)):
            said, spoke = (F.col(f"v{j}") == 1).cast("int"), (F.col(f"v{j}") >= 0).cast("int")
            sums += [F.sum(n * w * x).alias(f"{side}{name}{j}") for side, w in (("y", p), ("n", 1 - p)) for name, x in (("said", said), ("spoke", spoke))]
        for k in KINDS:
            own = (F.col("kind") == k).cast("int")
            sums += [F.sum(n * p * own).alias(f"p_{k}"), F.sum(n * own).alias(f"a_{k}")]
        got = patterns.agg(*sums).first()  # one row
        if not got["all"]:
            return {}
        # Weak beliefs that labelers are mostly right keep the two classes from changing places.
        yes = [(got[f"ysaid{j}"] + 8) / (got[f"yspoke{j}"] + 10) for j in range(len(LABELERS))]
        no = [(got[f"nsaid{j}"] + 2) / (got[f"nspoke{j}"] + 10) for j in range(len(LABELERS))]
        prior = {k: (got[f"p_{k}"] + 1) / (got[f"a_{k}"] + 2) for k in KINDS}
    soft = each.withColumn("p", posterior(lambda j: F.get("votes", j)))
    counts = (
        soft.select("p", F.explode(F.concat(F.array(F.lit("")), "features")).alias("feature"))
        .groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    )  # as many rows as the features have values
    total = next(r for r in counts if r["feature"] == "")
    odds = {r["feature"]: log((r["yes"] + 1) / (total["yes"] + 2)) - log((r["no"] + 1) / (total["no"] + 2)) for r in counts}
    odds[""] = log((total["yes"] + 1) / (total["no"] + 1))
    return odds


def judged(found: DataFrame, model: dict[str, float], column: str = "candidates", out: str = "spans") -> DataFrame:
    """Replaces the candidates by the spans that stay: kind, start, end, strict, chance; by kind, then start."""
    if model:
        weights = F.create_map(*(x for k, v in model.items() for x in (F.lit(k), F.lit(v))))
        odds = lambda c: F.aggregate(c["features"], F.lit(model[""]), lambda s, f: s + F.coalesce(weights[f], F.lit(0.0)))
    else:
        odds = lambda c: F.lit(0.0)
    weighed = F.transform(F.col(column), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict"), (1 / (1 + F.exp(-odds(c)))).alias("chance")))
    kept = F.filter(weighed, lambda c: c["strict"] & (c["kind"] != "secret") | (c["chance"] > SURE))
    new, = unused(found.columns, "kept")
    return found.withColumn(new, kept).drop(column, out).withColumnRenamed(new, out)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` for each span; of spans that overlap, one mark for the first stands for all."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def marked(parts: Column, o: Column) -> Column:
        reached = _running(F.transform(o, lambda s: s["end"].cast("int")), lambda x, y: F.greatest(x, y))

        def joined(upto: Column) -> Column:
            gap = lambda s, i: _piece(parts, F.get(upto, i), s["start"] - F.get(upto, i))
            mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            marks = F.transform(o, lambda s, i: F.when(s["start"] >= F.get(upto, i), F.concat(gap(s, i), mark(s))).otherwise(""))
            last = F.size(o) - 1
            end = F.greatest(F.get(upto, last), F.get(o, last)["end"])
            return F.concat(F.array_join(marks, ""), _piece(parts, end, F.length(text) - end))

        return _let(reached, joined)

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.struct(_cut(text).alias("parts"), order.alias("order")), lambda c: marked(c["parts"], c["order"])))
