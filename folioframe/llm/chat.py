"""Reply trees as conversations, in DataFrame operations only.

Paths from root to leaf come from iterated self-joins that double their reach: after k rounds every leaf
knows its ancestors up to 2^k - 1 steps, and every message the one 2^k steps up. Branches are ranked by score, and
each chosen path is formatted as one conversation with a loss mask over the assistants' texts.

Format of a turn: `<turn:ROLE>TEXT</turn>` and a line feed; in ROLE and TEXT `&`, `<` and `>` are written as
`&amp;`, `&lt;` and `&gt;`, so no text can make a control string and each is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def paths(messages: DataFrame) -> DataFrame:
    """(leaf, up, msg): every message on the way from each leaf (up = 0) to its root.

    messages(msg, parent): msg is unique and not null; a parent that is null or absent makes a root. Messages on a cycle
    have no leaf below them and give no path. Joins are on unique keys and their number is the
    logarithm of the depth; rows are those of the result.
    """
    known = messages.select(F.col("msg").alias("parent"))
    jump = written(messages.select("msg", "parent").join(known, "parent", "left_semi").select("msg", F.col("parent").alias("to")), "chat-jump")
    leaves = messages.select("msg").join(jump.select(F.col("to").alias("msg")), "msg", "left_anti")
    reached = written(leaves.select(F.col("msg").alias("leaf"), F.lit(0).cast("long").alias("up"), "msg"), "chat-paths")
    reach = 1
    while True:
        further = reached.join(jump, "msg").select("leaf", (F.col("up") + reach).alias("up"), F.col("to").alias("msg"))
        further = written(further, "chat-paths")
        if further.isEmpty():
            return reached
        reached = written(reached.unionByName(further), "chat-paths")
        jump = written(jump.select("msg", F.col("to").alias("via")).join(jump.select(F.col("msg").alias("via"), "to"), "via").select("msg", "to"), "chat-jump")
        reach *= 2


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, branch, up, msg) of messages(tree, msg, parent, score): branches of a tree ranked from 1 by the sum of the
    scores on the path (null: 0), ties to the smaller leaf; at most `best` of them where that is set."""
    steps = paths(messages)
    scored = steps.join(messages.select("msg", "score"), "msg").groupBy("leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    branches = messages.select("tree", F.col("msg").alias("leaf")).join(scored, "leaf").withColumn("branch", F.row_number().over(order))
    if best is not None:
        branches = branches.filter(F.col("branch") <= best)
    return steps.join(branches.select("tree", "leaf", "branch"), "leaf").select("tree", "leaf", "branch", "up", "msg")


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, branch, formatted, mask): one row for each chosen path of messages(tree, msg, parent, role, text, score).

    mask: spans (start, end) of code points of `formatted` that are assistants' (escaped) texts. Null texts and roles are
    empty. A path's turns meet in one row, as its output must.
    """
    turns = ranked_paths(messages, best).join(messages.select("msg", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text")), "msg")
    turn = F.concat(F.lit("<turn:"), "role", F.lit(">"), "text", F.lit(CLOSE))
    head = F.char_length("role") + 7
    order = Window.partitionBy("leaf").orderBy(F.desc("up"))
    before = F.coalesce(F.sum(F.char_length(turn).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.select("tree", "leaf", "branch", "up", "role", turn.alias("turn"), (before + head).alias("start"), (before + head + F.char_length("text")).alias("end"))
    said = F.when(F.col("role") == "assistant", F.struct("start", "end"))
    path = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn")))
    return placed.groupBy("tree", "leaf", "branch").agg(F.array_join(F.transform(path, lambda x: x["turn"]), "").alias("formatted"), F.sort_array(F.collect_list(said)).alias("mask")).select("tree", "branch", "formatted", "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text), and loss, the unescaped text under the mask, parsed from the formatted text."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, 7, 1 << 30), ">", 1)).alias("role"), unescape(F.substr(p, F.instr(p, ">") + 1)).alias("text")
    )
    # the mask is cut out of the text at its ends: code points from start to end
    under = F.transform("mask", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss", unescape(F.array_join(under, "")))


def linear_messages(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as reply chains: each row answers the one before it by turn.

    Equal turns follow by role and text; null turns come first; rows with a null conv_id are one conversation. Repeated rows all
    stay. The score of every message is null.
    """
    rows = written(rows.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("msg", F.monotonically_increasing_id()), "chat-messages")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text", "msg")
    return rows.select("tree", "msg", F.lag("msg").over(order).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def digest(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns and the digests of what was read back."""
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
