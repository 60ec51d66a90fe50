"""Chat formatting as a relational plan: sorted turn structs, array aggregation and concatenation, Spark functions only.

Template: a block `### role: text</turn>` and a line break for each run of turns of one role; the texts of a run are joined by
`<part/>`, so that reading back gives each turn again. Inside texts and roles control strings are escaped: the
backslash becomes `\\s`, `###` `\\h`, `</turn>` `\\e`, `<part/>` `\\p`, and in roles `:` `\\c`. As each backslash that is
left begins an escape, undoing them is exact.

A conversation becomes one row, so its turns meet in one task: that is the output's own size. But for the sort, all steps on them are
linear: what a lambda needs more than once is bound to a variable (`let`), turns are reached by their place, and spans count from
the start of their own part, so that no step reads a whole conversation or block again for each turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkferry.llm._frames import pick

END, PART = "</turn>\n", "<part/>"
#: Control strings and what stands for them, in the order in which escaping replaces them.
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"), ("<part/>", "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    for raw, mark in pairs:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often `use` names it, also within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_chat(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row for each conversation: the conversation's id, formatted string, and loss array<struct<block, part, start, end>>.

    Turns are in the order of turn, then role, then text (nulls first); a null text or role is empty; rows without an id
    are one conversation of id null; repeated rows stay. Adjacent turns of one role share a block.
    loss: the spans of each text of the role `learn`, in order. Blocks end with `</turn>` and a line break, `<part/>` parts them, and
    start and end are code points from the start of that part (a block's first part begins with `### role: `).
    """
    rows = pick(df, conv=conv, turn=turn, role=role, text=text)
    rows = rows.select("conv", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turn_at = lambda i: F.get("turns", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (turn_at(i)["role"] != turn_at(i - 1)["role"]))

    def run(first: Column, behind: Column) -> Column:
        return F.struct(
            turn_at(first)["role"].alias("role"),
            F.concat(F.lit("### "), escape(turn_at(first)["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"),
            F.transform(F.sequence(first, behind - 1), lambda i: escape(turn_at(i)["text"])).alias("parts"),
        )

    runs = let(starts, lambda at: F.transform(at, lambda first, k: run(first, F.coalesce(F.get(at, k + 1), F.size("turns")))))

    def block(r: Column) -> Column:
        return F.concat(r["head"], F.array_join(r["parts"], PART), F.lit(END))

    def spans(r: Column, k: Column) -> Column:
        begin = lambda p: F.when(p == 0, F.length(r["head"])).otherwise(F.lit(0))
        span = lambda text, p: F.struct(k.alias("block"), p.alias("part"), begin(p).alias("start"), (begin(p) + F.length(text)).alias("end"))
        return F.when(r["role"] == learn, F.transform(r["parts"], span)).otherwise(F.array().cast("array<struct<block:int,part:int,start:int,end:int>>"))

    both = let(runs, lambda x: F.struct(F.array_join(F.transform(x, block), "").alias("formatted"), F.flatten(F.transform(x, spans)).alias("loss")))
    return turns.select("conv", both.alias("made")).select(F.col("conv").alias(conv), "made.formatted", "made.loss")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.regexp_extract(b, "^### ([^:]*): ", 1)
        parts = let(role, lambda r: F.struct(unescape(r, ROLE_ESCAPES).alias("role"), F.split(F.substr(b, F.length(r) + 7), F.lit(PART), -1).alias("texts")))
        return let(parts, lambda x: F.transform(x["texts"], lambda p: F.struct(x["role"].alias("role"), unescape(p).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def under_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts that the loss spans cover, in order: array<string>."""
    blocks = F.transform(F.split(formatted, END, -1), lambda b: F.split(b, F.lit(PART), -1))
    cover = lambda x: F.transform(x["loss"], lambda s: unescape(F.substr(F.get(F.get(x["blocks"], s["block"]), s["part"]), s["start"] + 1, s["end"] - s["start"])))
    return let(F.struct(blocks.alias("blocks"), loss.alias("loss")), cover)
