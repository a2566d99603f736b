"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by (node, parent) within a conversation. Jump tables of 2**k parents are built by
joining a table with itself, and with them every root-to-leaf path is listed in as many joins as its
length has bits. Paths are ranked by the sum of their messages' scores, and each chosen path becomes one
conversation: every turn is ``<|role|>`` line, escaped text, ``<|end|>`` line. ``&``, ``<``, ``[`` and ``|>`` inside
roles and texts are written as references, so no control string of this or other templates can occur in
them and reading back is exact. The loss mask is the list of spans of the assistant's texts.

Defined cases: null text and null role are empty; a null conversation id is a conversation of its own;
rows that tie in all order columns are turns in any order; an empty table gives no rows; a message whose
parent is missing is a root; messages on or below a cycle of parents have no root and give no path;
columns other than those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import saved

#: What is written for each character that opens a control string; the first is undone last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|>", "&#124;>"))
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def chain(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations given as rows by turn, as trees in which each turn replies to the one before."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """All (conv key, leaf, node, place) of root-to-leaf paths; place counts back from the leaf."""
    nodes = messages.select("key", "node", "parent")
    known = nodes.select("key", F.col("node").alias("parent"))
    jump = saved(nodes.filter("parent is not null").join(known.distinct(), ["key", "parent"], "left_semi").select("key", "node", "parent"))
    leaves = nodes.select("key", "node").join(jump.select("key", F.col("parent").alias("node")).distinct(), ["key", "node"], "left_anti")
    jumps = []
    limit = max(1, jump.count()).bit_length() + 1
    while not jump.isEmpty() and len(jumps) <= limit:
        jumps.append(jump)
        ahead = jump.select("key", F.col("node").alias("parent"), F.col("parent").alias("next"))
        jump = saved(jump.join(ahead, ["key", "parent"]).select("key", "node", F.col("next").alias("parent")))
    if len(jumps) > limit:  # only cycles jump on for ever
        leaves = leaves.join(jump.select("key", "node"), ["key", "node"], "left_anti")
    found = leaves.select("key", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("place"))
    for k in reversed(range(len(jumps))):
        far = found.join(jumps[k], ["key", "node"]).select("key", "leaf", F.col("parent").alias("node"), (F.col("place") + (1 << k)).alias("place"))
        found = saved(found.unionByName(far))  # else every step would double the plan
    return found


def format_trees(messages: DataFrame, *, branches: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row a chosen path: conv, branch (rank, from 1), score, formatted, loss_spans (start from 0, length).

    messages: conv, node, parent, role, text, score. branches: how many best paths of each conversation to
    take; None takes all.
    """
    messages = messages.select(F.when(F.col("conv").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))).alias("key"), "conv", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    messages = saved(messages)
    marker = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    turn = messages.select("key", "conv", "node", "score", marker.alias("marker"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("learn"))
    rows = paths(messages).join(turn, ["key", "node"])
    size = F.length("marker") + F.length("body") + len(END)
    order = Window.partitionBy("key", "leaf").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("start", F.sum(size).over(order) - F.length("body") - len(END))
    rows = rows.groupBy("key", "leaf").agg(
        F.first("conv").alias("conv"),
        F.sum("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "marker", "body", "learn"))).alias("turns"),
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["marker"], t["body"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), "leaf"))
    out = rows.select("key", "conv", "leaf", "score", formatted.alias("formatted"), spans.alias("loss_spans")).withColumn("branch", rank)
    if branches is not None:
        out = out.filter(F.col("branch") <= branches)
    return out.select("conv", "branch", "score", "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: turns (role, text) and the text under the loss mask, both unescaped."""
    parts = F.split("formatted", r"<\|end\|>\n")
    role = lambda t: F.substr(F.substring_index(t, "|>\n", 1), F.lit(3))
    text = lambda t: F.substr(t, F.instr(t, "|>\n") + 3)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda t: F.struct(unescape(role(t)).alias("role"), unescape(text(t)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss": F.array_join(loss, "")})


def digests(formatted: DataFrame) -> DataFrame:
    """One row a formatted conversation, all read back from the output."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        F.col("conv").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
