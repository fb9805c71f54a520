"""Conversation structure repair by a square-root checkpointed dynamic programme.

The turns of a conversation are symbols: the role's initial, and whether the turn has
to go (blank or repeated) or breaks off. An automaton of four states (nothing yet,
after a system turn, after a user, after an assistant) reads the edited turns, and the
cheapest edits are a shortest path through it. A conversation of n turns is cut into
blocks of about the root of n turns, each a row of Spark:

1. each block gives its 4 x 4 matrix of least costs from state to state;
2. the matrices of a conversation, of which there are about the root of n, give the
   state-cost vector at each checkpoint, from the end backwards; these alone are kept;
3. each block, recomputed between its two checkpoints, walks forward from every state
   and tells where it ends; these maps, chained, give the state that each block really starts in;
4. each block is recomputed once more and walks from its own state, taking the
   ASCII-least edit that is still tight, and emits the edits.

So no task holds more than the root of a conversation's turns, whatever its length, and
texts never leave their rows. Among edits of one cost the least audit is found by
the greedy walk, as no two different edit strings of one cost stand in a prefix relation.

Defined results: rows are ordered by turn (nulls first), then role, then text, nulls as one space; a
null role or text is one space; a role's initial is its first code point, and unknown or empty
roles fit nowhere until they are given a role; rows alike in all but their place are
repeated ones; a conversation without rows has no edits; a null id is a conversation of its
own; texts of any length stay whole; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.llm.arrays import bounded
from typeweave.operators.offsets import placed
from typeweave.sources.tables import handed_over

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
#: The state that a kept turn of each role leads to from each state, and the one that an inserted or rerouted turn leads to.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
_SPACE = r"[\x20\x09-\x0D]"


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    """The last character that isn't white space ends no sentence."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def conversation(conv: Column) -> Column:
    """A string that names a conversation, also one with a null id."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def ordered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, place, fault, initial) of all rows: places from 0, and blank, duplicate, truncated or null."""
    slim = rows.select(
        conversation(F.col(conv)).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    known = placed(slim, ["conv"], [F.asc_nulls_first("turn"), "role", "text"], "place").withColumn("said", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    known = handed_over(known, "repair-rows")
    again = known.groupBy("conv", "said").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("conv", "said", "first")
    fault = F.when(blank(F.col("text")), "blank").when(F.col("place") > F.col("first"), "duplicate").when(truncated(F.col("text")), "truncated")
    joined = known.join(handed_over(again, "repair-repeated"), ["conv", "said"], "left")
    return handed_over(joined.select("conv", "turn", "role", "text", "place", fault.alias("fault"), F.substring("role", 1, 1).alias("initial")), "repair-rows")


def _symbol() -> Column:
    """One character a row: s, u, a or o (another role), a capital where the turn breaks off, and x for one that has to go."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) that use up the row, in the order of their letters."""
    moves = [("D", DELETE, state)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        if state in KEPT.get(symbol.lower(), {}):
            moves.append(("K", KEEP + more, KEPT[symbol.lower()][state]))
        moves.append(("R", REROLE + more, NEXT[state]))
    return moves


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first; two in a row lead back to where they began."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def _vectors(symbols: str, after: tuple[int, ...]) -> list[list[int]]:
    """Costs to go before each row of a block and after its last, where ``after`` holds behind it."""
    out = [list(after)]
    for symbol in reversed(symbols):
        out.append(_with_inserts([min(c + out[-1][t] for _, c, t in _moves(symbol, s)) for s in range(4)]))
    return out[::-1]


@lru_cache(100_000)
def _matrix(symbols: str) -> tuple[int, ...]:
    """Least costs from each state before a block to each state behind it, row by row."""
    columns = [_vectors(symbols, tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
    return tuple(min(columns[t][s], FAR) for s in range(4) for t in range(4))


def final_costs() -> tuple[int, ...]:
    return tuple(_with_inserts([0 if s in ACCEPTED else FAR for s in range(4)]))


@lru_cache(100_000)
def _walk(symbols: str, state: int, after: tuple[int, ...]) -> tuple[tuple[str, ...], tuple[int, ...], int]:
    """(edits before and at each row, state before each row's edits, state at the end): the least tight edits of a block."""
    vectors = _vectors(symbols, after)
    edits, states = [], []
    for k, symbol in enumerate(symbols):
        done, before, cost = "", state, vectors[k][state]
        while True:
            tight = [(e, t) for e, c, t in _moves(symbol, state) if c + vectors[k + 1][t] == cost]
            if INSERT + vectors[k][NEXT[state]] == cost:
                tight.append(("I", NEXT[state]))
            edit, state = min(tight)
            cost = vectors[k][state] if edit == "I" else cost
            done += edit
            if edit != "I":
                break
        edits.append(done)
        states.append(before)
    return tuple(edits), tuple(states), state


def _tail(state: int) -> str:
    """What is inserted behind the last row."""
    done = ""
    while state not in ACCEPTED:
        done, state = done + "I", NEXT[state]
    return done


def edits(rows: DataFrame) -> DataFrame:
    """(conv, place, edits, state, tail) of rows from ``ordered``: the letters up to and of this row's edit, the
    state before them, and on the last row of a conversation what is inserted behind it."""
    coded = rows.select("conv", "place", _symbol().alias("symbol"))
    sizes = handed_over(coded.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("bigint").alias("width")), "repair-sizes")
    blocks = handed_over(
        coded.join(sizes, "conv").withColumn("block", F.expr("place div width")).groupBy("conv", "block")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"), F.min("place").alias("first")),
        "repair-blocks",
    )

    @F.pandas_udf("array<bigint>")
    def matrix(symbols: pd.Series) -> pd.Series:
        return symbols.map(lambda s: list(_matrix(s)))

    @F.pandas_udf("array<struct<block: bigint, after: array<bigint>>>")
    def checkpoints(matrices: pd.Series) -> pd.Series:
        def of(held):
            costs, out = final_costs(), []
            for x in sorted(held, key=lambda x: -x["block"]):
                out.append({"block": x["block"], "after": list(costs)})
                m = x["matrix"]
                costs = [min(min(m[4 * s + t] + costs[t] for t in range(4)), FAR) for s in range(4)]
            return out

        return matrices.map(of)

    by_conv = blocks.select("conv", "block", matrix("symbols").alias("matrix")).groupBy("conv").agg(F.collect_list(F.struct("block", "matrix")).alias("m"))
    stored = by_conv.select("conv", F.explode(checkpoints("m")).alias("c")).select("conv", "c.*")
    blocks = handed_over(blocks.join(stored, ["conv", "block"]), "repair-blocks")

    @F.pandas_udf("array<int>")
    def ends(symbols: pd.Series, after: pd.Series) -> pd.Series:
        def of(s, a):
            a = tuple(int(x) for x in a)
            possible = _vectors(s, a)[0]
            return [_walk(s, state, a)[2] if possible[state] < FAR else state for state in range(4)]

        return pd.Series([of(s, a) for s, a in zip(symbols, after)])

    @F.pandas_udf("array<struct<block: bigint, begins: int, last: boolean>>")
    def chained(maps: pd.Series) -> pd.Series:
        def of(held):
            state, out, held = START, [], sorted(held, key=lambda x: x["block"])
            for x in held:
                out.append({"block": x["block"], "begins": state, "last": x["block"] == held[-1]["block"]})
                state = int(x["ends"][state])
            return out

        return maps.map(of)

    maps = blocks.select("conv", "block", ends("symbols", "after").alias("ends")).groupBy("conv").agg(F.collect_list(F.struct("block", "ends")).alias("m"))
    begun = maps.select("conv", F.explode(chained("m")).alias("c")).select("conv", "c.*")

    @F.pandas_udf("array<struct<k: int, edits: string, state: int, tail: string>>")
    def walked(symbols: pd.Series, after: pd.Series, begins: pd.Series, last: pd.Series) -> pd.Series:
        def of(s, a, state, is_last):
            done, states, end = _walk(s, int(state), tuple(int(x) for x in a))
            return [{"k": k, "edits": e, "state": t, "tail": _tail(end) if is_last and k == len(s) - 1 else ""} for k, (e, t) in enumerate(zip(done, states))]

        return pd.Series([of(*row) for row in zip(symbols, after, begins, last)])

    each = blocks.join(begun, ["conv", "block"]).select("conv", "first", F.explode(walked("symbols", "after", "begins", "last")).alias("e"))
    return each.select("conv", (F.col("first") + F.col("e.k")).alias("place"), "e.edits", "e.state", "e.tail")


def costs(fault: Column, done: Column, tail: Column) -> Column:
    """What the edits of a row cost."""
    own = F.substring(done, -1, 1)
    return (
        F.when(own == "D", DELETE).otherwise(F.when(own == "R", REROLE).otherwise(KEEP) + F.when(fault == "truncated", TRUNCATED).otherwise(0))
        + INSERT * (F.length(done) - 1 + F.length(tail))
    ).cast("bigint")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, part, role, text) of the repaired turns, in this order; ``rows`` from ``ordered``, ``found`` from ``edits``."""
    # Role by state: what is inserted or rerouted alternates from the state before it.
    named = lambda state: F.when(state == USER, "assistant").otherwise("user")
    inserts = F.length("edits") - 1
    after = F.when(inserts % 2 == 0, F.col("state")).otherwise(F.when(F.col("state") == USER, ASSISTANT).otherwise(USER))
    alternate = lambda k: F.when(k % 2 == 0, named(F.col("state"))).otherwise(F.when(F.col("state") == USER, "user").otherwise("assistant"))
    none = F.array().cast("array<struct<part: bigint, role: string, text: string>>")
    put = lambda n, role, base: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k + base).cast("bigint").alias("part"), role(k).alias("role"), F.lit("").alias("text")))).otherwise(none)
    own = F.substring("edits", -1, 1)
    kept = F.when(own == "D", none).otherwise(F.array(F.struct(F.lit(1 << 20).cast("bigint").alias("part"), F.when(own == "R", named(after)).otherwise(F.col("role")).alias("role"), F.col("text").alias("text"))))
    # Behind the last row only a missing answer is ever inserted, or a turn and its answer after a system turn.
    behind = put(F.length("tail"), lambda k: F.when((F.length("tail") - k) % 2 == 1, "assistant").otherwise("user"), 2 << 20)
    return rows.join(found, ["conv", "place"]).select("conv", "place", F.explode(F.concat(put(inserts, alternate, 0), kept, behind)).alias("o")).select("conv", "place", "o.*")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's repaired ``role:text`` lines, hashed as they stream by in order, so no conversation is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("conv").to_pylist(), batch.column("line")):
                if c != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "sha256"])

    lines = turns.select("conv", "place", "part", F.concat_ws(":", "role", "text").alias("line"))
    return bounded(lines.repartition("conv").sortWithinPartitions("conv", "place", "part")).mapInArrow(run, "conv string, sha256 string")


def audited(every: DataFrame, conv: str, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``every``.

    An audit is a string of a letter for each edit, so it grows with its conversation; texts never stand in it.
    """
    fits = F.concat("initial", "_next").isin("su", "ua", "au")
    joined = rows.drop("text").join(found, ["conv", "place"])
    following = rows.select("conv", (F.col("place") - 1).alias("place"), F.col("initial").alias("_next"))
    illegal = joined.select("conv", "place", "initial").join(following, ["conv", "place"]).where(~fits).groupBy("conv").agg(F.count(F.lit(1)).alias("illegal"))
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    turns = rows.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("edits", "tail").alias("e")))), lambda x: x["e"]), "")
    sums = joined.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"), F.sum(costs(F.col("fault"), F.col("edits"), F.col("tail"))).alias("cost"), letters.alias("audit"))
    ids = every.select(F.col(conv).alias("conv_id")).distinct().withColumn("conv", conversation(F.col("conv_id")))
    out = ids.join(sums, "conv", "left").join(turns, "conv", "left").join(illegal, "conv", "left").join(digests(repaired(rows, found)), "conv", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
