r"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are its
context and only that reply is trainable. A conversation that doesn't end with
an assistant turn has one more example, without a target, so that no turn is
lost. Examples of a conversation are numbered in turn order.

A turn is written ``<|turn|>ROLE\nTEXT<|end|>\n``. Control strings (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) inside a
text or role get a backslash behind their first character, and those that had
backslashes there already get one more; so all texts can be read back, and texts
without control strings stay as they are.

Defined results: rows are ordered by turn (nulls first), then role and text as they
were before escaping; repeated rows are turns of their own; a null text or role is an empty one; rows
with a null conversation form one conversation; very long texts are formatted whole;
columns other than those named
are left out, whatever their names; an empty table gives no examples.

The last example of a conversation is one value that holds all of its turns, and what
all of its examples hold together grows with the square of its turns. A conversation is
therefore the unit of work and has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_REST = r"(\||/?s>|/?SYS>>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _REST, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)\\" + _REST, r"$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv, example, target_turn, formatted, loss_start, loss_chars.

    loss_start is the 0-based code point of ``formatted`` where the trainable
    text begins; it has loss_chars code points (null and 0 without a target).
    Examples are cut from a conversation one by one.
    """
    role_text = F.coalesce(F.col(role), F.lit(""))
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit(OPEN), _role_out(role_text), F.lit("\n"))
    one = F.struct(
        F.col(turn).alias("turn"), role_text.alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), body.alias("body"),
        F.concat(head, body, F.lit(CLOSE)).alias("whole"), F.length(head).alias("head"),
    )
    conversations = rows.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    last = F.size("turns") - 1
    at = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (F.get("turns", i)["role"] == "assistant") | (i == last),
    )
    target = F.get("turns", F.col("at"))
    trainable = target["role"] == "assistant"
    context = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda t: t["whole"]), "")
    return (
        conversations.select("conv", "turns", F.posexplode(at).alias("example", "at"))
        .select(
            "conv", "example", F.when(trainable, target["turn"]).alias("target_turn"),
            context.alias("context"), target["whole"].alias("reply"),
            F.when(trainable, F.lit(0) + target["head"]).alias("in_reply"),
            F.when(trainable, F.length(target["body"])).otherwise(0).alias("loss_chars"),
        )
        .select(
            F.col("conv").alias(conv), "example", "target_turn",
            F.concat("context", "reply").alias("formatted"),
            (F.length("context") + F.col("in_reply")).alias("loss_start"), "loss_chars",
        )
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, read back; empty without a target."""
    return unescaped(F.when(start.isNull(), "").otherwise(F.substring(formatted, start + 1, chars)))


def turns_back(formatted: Column) -> Column:
    """The (role, text) structs that a formatted example was made of."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    def back(piece: Column) -> Column:
        # Spark's instr is 1-based; the role's own line breaks are escaped.
        cut = F.instr(piece, "\n")
        return F.struct(
            _role_back(F.substring(piece, F.lit(1), cut - 1)).alias("role"),
            unescaped(F.substring(piece, cut + 1, F.length(piece) - cut - len(CLOSE))).alias("text"),
        )
    return F.transform(pieces, back)
