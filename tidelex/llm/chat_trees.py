"""Reply trees to training conversations.

Messages point to the message they answer. Iterative self-joins, each doubling the reach of every pointer,
enumerate root-to-leaf paths in about log2(depth) rounds; leaves are ranked by the score summed along their path,
and every chosen path is formatted as one conversation with a loss mask over the assistant texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelex.llm.common import cut

HEAD, END = "### ", "</turn>\n"
#: What an escape stands for; the backslash comes first when escaping and last when reading back.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, role: bool = False) -> Column:
    """After this no ``#``, ``<`` (or, in roles, ``:``) is left, so a text can't hold a control string."""
    return _replaced(text, ROLE_ESCAPES if role else ESCAPES)


def unescape(text: Column, role: bool = False) -> Column:
    return _replaced(text, [(b, a) for a, b in reversed(ROLE_ESCAPES if role else ESCAPES)])


def _score() -> Column:
    return F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf_id, branch (1 is best), step (0 is the root), msg_id: the chosen root-to-leaf paths.

    ``messages``: conv_id, msg_id, parent_id, score. A message whose parent is null or missing is a root. Of
    messages that repeat (conv_id, msg_id) the one with the smallest (parent_id, score, role, text) counts, null first,
    here and in ``format_paths``. Null and NaN scores count as 0. An empty table gives no paths. Ties between branches go to the smaller leaf id. Messages on a reply cycle, or below one, have no root
    and are on no path. Rows without conv_id or msg_id are left out. ``branches=None`` keeps every leaf.
    """
    key = ["conv_id", "msg_id"]
    nodes = messages.where("conv_id is not null and msg_id is not null").groupBy(*key).agg(F.min(F.struct("parent_id", _score())).alias("m"))
    nodes = cut(nodes.select(*key, F.col("m.parent_id").alias("parent_id"), F.col("m.score").cast("double").alias("score")))
    known = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    reach = cut(nodes.join(known, ["conv_id", "parent_id"], "left").select(*key, F.when(F.col("known"), F.col("parent_id")).alias("up"), F.col("score").alias("total")))
    rooted, levels, most = reach.where("up is null"), [reach.where("up is not null")], max(1, nodes.count()).bit_length() + 1
    while len(levels) <= most and not levels[-1].isEmpty():  # only messages that have not reached their root move on
        there = rooted.unionByName(levels[-1]).select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"))
        moved = cut(levels[-1].join(there, ["conv_id", "up"]).select(*key, F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total")))
        rooted = rooted.unionByName(moved.where("up is null"))
        levels.append(moved.where("up is not null"))
    # what still points upwards is on a cycle or below one
    inner = reach.where("up is not null").select("conv_id", F.col("up").alias("msg_id")).distinct()
    leaves = rooted.join(inner, key, "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "msg_id"))
    leaves = leaves.withColumn("branch", rank)
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    path = leaves.select("conv_id", F.col("msg_id").alias("leaf_id"), "branch", "msg_id", F.lit(0).alias("above"))
    for k in reversed(range(len(levels) - 1)):  # every distance to the leaf is a sum of powers of two
        hop = levels[k].select("conv_id", "msg_id", "up")
        both = F.array(F.struct("msg_id", "above"), F.struct(F.col("up").alias("msg_id"), (F.col("above") + (1 << k)).alias("above")))
        path = path.join(hop, key, "left").select("conv_id", "leaf_id", "branch", F.explode(F.filter(both, lambda x: x["msg_id"].isNotNull())).alias("x")).select("conv_id", "leaf_id", "branch", "x.*")
    length = F.max("above").over(Window.partitionBy("conv_id", "leaf_id"))
    return path.select("conv_id", "leaf_id", "branch", (length - F.col("above")).alias("step"), "msg_id")


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, leaf_id, branch, formatted, loss_spans array<struct<start,length>>: one conversation per path.

    Each turn reads ``### role: text</turn>`` and a line break, with role and text escaped. Spans count code
    points from 0 and cover exactly the escaped texts of role "assistant". Null roles and texts count as empty.
    Of messages that repeat an id the same one counts as in ``reply_paths``. Other columns are not read.
    """
    key = ["conv_id", "msg_id"]
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    bodies = messages.where("conv_id is not null and msg_id is not null").groupBy(*key).agg(F.min(F.struct("parent_id", _score(), role.alias("role"), text.alias("text"))).alias("m"))
    turns = paths.join(bodies, key).select(
        "conv_id", "leaf_id", "branch", "step", F.concat(F.lit(HEAD), escape(F.col("m.role"), role=True), F.lit(": ")).alias("head"), escape(F.col("m.text")).alias("body"), (F.col("m.role") == "assistant").alias("learn")
    )
    made = turns.groupBy("conv_id", "leaf_id", "branch").agg(F.array_sort(F.collect_list(F.struct("step", "head", "body", "learn"))).alias("t"))
    start = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x.head) + F.length(x.body) + len(END)).cast("long").alias("at"),
            F.when(x.learn, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(x.head)).cast("long").alias("start"), F.length(x.body).cast("long").alias("length"))))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return made.select("conv_id", "leaf_id", "branch", formatted.alias("formatted"), start.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p, F.lit(len(HEAD) + 1), F.instr(p, F.lit(": ")) - len(HEAD) - 1), role=True).alias("role"), unescape(F.substring(p, F.instr(p, F.lit(": ")) + 2, F.length(p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Reply trees of (conv_id, turn, role, text) rows, in which each turn answers the one before it.

    Rows with the same turn follow each other by role and text, a null turn comes first. The score is the text's
    length in code points. Rows of a null conv_id are numbered as one conversation, which ``reply_paths`` leaves out unless
    the caller gives it an id. Texts of any length are taken whole, an empty table gives no rows, other columns are not read.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
