"""Operator 10: chat formatting of reply trees, in DataFrame functions only.

Messages form trees by their parent. Root-to-leaf paths are enumerated by iterative
self-joins that double their reach each round. Only ids and scores travel through these
joins; texts are joined once, at the end. Branches of a tree are ranked by
score, and each chosen path becomes one conversation in the template

    <|turn|>role<|text|>text<|end|>

Control strings inside texts and roles are escaped reversibly, so that a formatted
conversation can be split at its marks and read back."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What is escaped inside texts, in this order; undone in the reverse order. Fixed values of the format.
ESCAPES = [("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]")]


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (("<", "&lt;"), ("[", "&lb;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _joined(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on equal keys, of which "tree" may be null: messages without a tree belong to one tree of their own."""
    other = right.withColumnsRenamed({k: f"other {k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"other {k}")) if k == "tree" else F.col(k) == F.col(f"other {k}") for k in keys]
    return left.join(other, reduce(and_, same), how).drop(*[f"other {k}" for k in keys])


def _heights(own: DataFrame) -> DataFrame:
    """(tree, node, parent, score, height) of the nodes that reach a root; a root has height 1.

    Pointer doubling: each round joins every node with the node that its pointer has reached, which doubles
    the distance. Nodes on a parent cycle, or below one, never end and are left out."""
    going = cut(own.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("height")))
    nodes, reach = going.count(), 1
    while reach <= nodes and not going.where("up is not null").isEmpty():
        above = going.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("height").alias("more"))
        ended = going.where("up is null")
        grown = _joined(going.where("up is not null"), above, "tree", "up").select("tree", "node", F.col("further").alias("up"), (F.col("height") + F.col("more")).alias("height"))
        going, reach = cut(grown.unionByName(ended)), 2 * reach
    return _joined(own, going.where("up is null").select("tree", "node", "height"), "tree", "node")


def reply_paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Root-to-leaf paths of the trees in `messages` (tree, node, parent, score).

    Returns (tree, leaf, rank, score, path): path is the array of nodes from root to leaf, score
    the mean of its nodes' scores (null scores count 0), rank 1 the best, ties by leaf.
    A node whose parent is null or absent from its tree is a root. Nodes on a parent cycle
    reach no root and are on no path. `top` keeps that many branches of each tree (the feature);
    None keeps all. (tree, node) must be unique; a null tree is a tree like others, a null node is on no path. The number of rounds is the logarithm of the
    depth: in round r only nodes of a height divisible by 2^r hold the 2^r nodes up from
    them, and a path takes such a piece where its height has bit r, so all pieces together
    are no larger than the messages and the paths."""
    own = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = own.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    own = cut(_joined(own, known, "tree", "parent", how="left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))
    high = cut(_heights(own))
    inner = own.select("tree", F.col("parent").alias("node")).distinct()
    leaf = F.struct("height", F.lit(0.0).alias("total"), F.expr("cast(array() as array<bigint>)").alias("path"))
    open_ = cut(_joined(high, inner, "tree", "node", how="left_anti").select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), leaf.alias("p")))
    pieces = high.select("tree", F.col("node").alias("at"), F.col("parent").alias("up"), "height", F.col("score").alias("sum"), F.array(F.col("node").cast("long")).alias("piece"))
    most = high.agg(F.max("height")).first()[0] or 0
    bit = 1
    while bit <= most:
        here = F.col("p.height").bitwiseAND(F.lit(bit)) > 0
        grown = F.struct(F.col("p.height").alias("height"), (F.col("p.total") + F.col("sum")).alias("total"), F.concat("piece", "p.path").alias("path"))
        taken = _joined(open_.where(here), pieces.select("tree", "at", "up", "sum", "piece"), "tree", "at").select("tree", "leaf", F.col("up").alias("at"), grown.alias("p"))
        open_ = cut(taken.unionByName(open_.where(~here)))
        bit *= 2
        if bit <= most:
            above = pieces.select("tree", F.col("at").alias("up"), F.col("up").alias("further"), F.col("sum").alias("more"), F.col("piece").alias("upper"))
            pieces = cut(
                _joined(pieces.where(F.pmod("height", F.lit(bit)) == 0), above, "tree", "up")
                .select("tree", "at", F.col("further").alias("up"), "height", (F.col("sum") + F.col("more")).alias("sum"), F.concat("upper", "piece").alias("piece"))
            )
    found = open_.select("tree", "leaf", (F.col("p.total") / F.col("p.height")).alias("score"), F.col("p.path").alias("path"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    rank = found.select("tree", "leaf", F.row_number().over(order).alias("rank"))
    ranked = _joined(found, rank, "tree", "leaf")
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("tree", "leaf", "rank", "score", "path")


def format_chat(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation for each row of `paths`: (tree, leaf, rank, formatted).

    `messages` (tree, node, role, text) gives the turns; null roles and texts count as empty."""
    turns = _joined(paths.select("tree", "leaf", "rank", F.posexplode("path").alias("pos", "node")), messages.select("tree", "node", "role", "text"), "tree", "node")
    turn = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    rows = turns.select("tree", "leaf", "rank", F.struct("pos", turn.alias("turn")).alias("t"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("t")), lambda x: x["turn"]))
    return rows.groupBy("tree", "leaf", "rank").agg(joined.alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring_index(x, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as messages of a tree in which each turn answers the one before.

    Rows of one turn follow each other by role and text (nulls count as empty, a null turn comes first); a repeated row is a turn
    of its own; rows without conv_id make one conversation with a null id. The window holds ids, turn numbers and hashes of one conversation."""
    order = Window.partitionBy("tree").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text")
    )
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = cut(linear_messages(given.unionByName(extra)))
    chats = format_chat(reply_paths(messages), messages)
    turns = chats.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"))
    every = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    masked = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
