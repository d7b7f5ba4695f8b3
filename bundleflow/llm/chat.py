"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees through ``parent``.  Root-to-leaf paths come from iterative self-joins that double the known
stretch of every path: after k rounds a row knows its ancestors up to distance 2**k, so a tree of depth d takes
log2(d) joins.  Each leaf is one branch; branches are ranked by the sum of their messages' scores (ties: smaller leaf
id), and the best ``top`` of each tree are formatted, one conversation each.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and texts ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (in roles a line feed becomes ``&#10;``), so no text can open or close a turn and the original returns
exactly.  The loss mask lists (start, length) of the assistant texts in code points of the formatted string.

Defined results: a null text or role is empty; a null turn sorts first; repeated rows are kept as turns of their own,
in the order turn, role, text; rows without conversation id form one conversation with a null id; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def reply_tree(turns: DataFrame) -> DataFrame:
    """Messages (conv_id, node, parent, role, text, score) of conversations listed by turn.

    ``node`` counts a conversation's rows from 1; each row replies to the one before it.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    return (rows.withColumn("node", node)
            .select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    "role", "text", F.lit(0.0).alias("score")))


def branches(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, steps): every root-to-leaf path as rows; ``steps`` is the distance from the leaf.

    ``messages`` is a stored table; a link that leads to no message ends the path there.
    Links that form a cycle raise an error.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))  # null ids join too
    links = messages.select("conv_id", key.alias("tree"), "node", "parent")
    # jump[node] = ancestor at distance 2**k
    jump = links.where("parent is not null").select("tree", F.col("node").alias("from"), F.col("parent").alias("to"))
    parents = links.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    paths = (links.join(parents, ["tree", "node"], "left_anti")
             .select("conv_id", "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps")))
    paths, distance, most = stored(paths, "paths"), 1, messages.count()
    while True:
        further = (paths.join(jump.withColumnRenamed("from", "node"), ["tree", "node"])
                   .select("conv_id", "tree", "leaf", F.col("to").alias("node"),
                           (F.col("steps") + distance).alias("steps")))
        grown = stored(paths.unionByName(further), "paths")
        distance *= 2
        # a node without an ancestor at that distance has no row in the next table
        jump = stored(jump.alias("a").join(jump.alias("b"), (F.col("a.tree") == F.col("b.tree"))
                                           & (F.col("a.to") == F.col("b.from")))
                      .select("a.tree", "a.from", F.col("b.to").alias("to")), "jumps")
        paths = grown
        if jump.isEmpty():
            return paths
        if distance > most:
            raise ValueError("the links form a cycle")


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, leaf, formatted, loss): the best branches of each tree.

    ``loss`` is an array of (start, length): the assistant texts inside ``formatted``.
    """
    messages = stored(messages, "messages")
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    body = messages.select(key.alias("tree"), "node", "role", "text", "score")
    along = branches(messages).join(body, ["tree", "node"])
    turn = F.struct((-F.col("steps")).alias("at"), "role", "text")
    whole = along.groupBy("conv_id", "tree", "leaf").agg(
        F.sum("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    best = F.row_number().over(Window.partitionBy("conv_id", "tree").orderBy(F.desc("score"), "leaf"))
    ranked = whole.withColumn("_rank", best).where(F.col("_rank") <= top)

    pieces = F.transform("turns", lambda t: F.struct(
        (t.role == "assistant").alias("learn"),
        F.concat(F.lit(START), escape_role(t.role), F.lit("\n")).alias("head"),
        escape(t.text).alias("body")))
    ranked = ranked.withColumn("_pieces", pieces).withColumn(
        "formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p.head, p.body, F.lit(END + "\n"))), ""))
    empty = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    loss = F.aggregate(
        "_pieces", F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, p: F.struct(
            (a.at + F.length(p.head) + F.length(p.body) + len(END) + 1).alias("at"),
            F.when(p.learn, F.concat(a.out, F.array(F.struct(
                (a.at + F.length(p.head)).alias("start"), F.length(p.body).alias("length"))))).otherwise(a.out)
            .alias("out")),
        lambda a: a.out)
    return ranked.select("conv_id", "leaf", "formatted", loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(..., turns, learned): turns parsed from the formatted string, and the unescaped text under the loss mask."""
    parts = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n", -1), lambda p: p != "")
    turns = F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))
    learned = F.array_join(F.transform("loss", lambda m: unescape(
        F.substr(F.col("formatted"), m.start + 1, m.length))), "")
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def digest(formatted: DataFrame) -> DataFrame:
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
