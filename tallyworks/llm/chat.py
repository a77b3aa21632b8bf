"""Chat formatting of reply trees.

Messages form trees (parent links). Iterative self-joins find, for every
message, its root, depth and the sum of scores on the way: each round joins the
table with itself and doubles the known distance, so a thread of n messages
takes log2(n) rounds. Leaves are the branches' ends; within a tree they are
ranked by mean score, and each chosen branch is walked back by the same jumps
and formatted as one conversation.

Template: every turn is ``<|role|>\\n`` text ``<|end|>\\n``. Control strings in
texts and roles are escaped reversibly: a backslash is doubled, and the first
character of a control string (``<|`` and the marks of other common templates)
gets a backslash behind it. A backslash thus always stands before the character
it protects, and dropping it gives back the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

#: What follows the first character of a control string.
CONTROL = r"([<\[])(\||INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>)"
END = "<|end|>\n"
LOSS_ROLE = "assistant"
#: A thread of 2 ** MAX_ROUNDS messages can't be; links that need more go in circles.
MAX_ROUNDS = 48


def escape(text):
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role):
    return F.regexp_replace(role, r"([\\|<>\[\]\n])", r"\\$1")


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, rank, msg_id, place): the messages of the ``top`` best root-to-leaf paths of every tree.

    ``messages`` has tree_id, msg_id (unique), parent_id (null at a root) and
    score. A parent that isn't there makes its child a root; a null score
    counts 0; parents in a circle raise ValueError. Paths rank by mean score, then length, then the leaf's id.
    """
    base = messages.select(
        "tree_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    real = base.select(F.col("msg_id").alias("parent_id"), F.lit(True).alias("_real"))
    base = base.join(real, "parent_id", "left").withColumn("parent_id", F.when(F.col("_real"), F.col("parent_id"))).drop("_real")
    base = materialize(base, "chat-messages")
    # jump: the ancestor ``2 ** round`` steps up, with steps and scores on the way (the message's own included)
    jump = materialize(
        base.select("msg_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")),
        "chat-jump",
    )
    done, active = jump.where("up IS NULL"), jump.where("up IS NOT NULL")
    rounds = []
    while not active.isEmpty():
        if len(rounds) > MAX_ROUNDS:
            raise ValueError("parent links form a cycle")
        rounds.append(active.select("msg_id", "up"))
        far = done.unionByName(active).select(
            F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("sum").alias("sum2")
        )
        step = active.join(far, "up").select(
            "msg_id",
            F.col("up2").alias("up"),
            (F.col("steps") + F.col("s2")).alias("steps"),
            (F.col("sum") + F.col("sum2")).alias("sum"),
        )
        step = materialize(step, "chat-jump")  # only the messages that haven't reached their root
        done, active = done.unionByName(step.where("up IS NULL")), step.where("up IS NOT NULL")
    jump = done
    leaves = base.join(base.select(F.col("parent_id").alias("msg_id")).where("msg_id is not null").distinct(), "msg_id", "left_anti")
    scored = leaves.select("tree_id", "msg_id").join(jump.select("msg_id", "steps", "sum"), "msg_id")
    order = Window.partitionBy("tree_id").orderBy((F.col("sum") / F.col("steps")).desc(), F.desc("steps"), "msg_id")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    path = chosen.select("tree_id", "rank", "msg_id", F.col("steps").alias("place"))
    for k in range(len(rounds) - 1, -1, -1):  # from the leaf up, by halving jumps: each place is reached once
        higher = path.join(rounds[k], "msg_id").select("tree_id", "rank", F.col("up").alias("msg_id"), (F.col("place") - 2**k).alias("place"))
        path = path.unionByName(higher)
        if k % 4 == 0:
            path = materialize(path, "chat-path")
    return path


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """One formatted conversation per chosen branch: tree_id, rank, formatted, loss_spans, n_turns.

    ``messages`` has tree_id, msg_id, parent_id, score, role and text. A null
    text or role is empty. loss_spans holds (start, end) of every assistant
    text within ``formatted``, in code points, end exclusive, in order. Other
    columns are not read; an empty table gives an empty result.
    """
    path = branches(messages, top)
    said = messages.select(
        "msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = path.join(said, "msg_id")
    head = F.concat(F.lit("<|"), escape_role("role"), F.lit("|>\n"))
    turns = turns.select("tree_id", "rank", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    grouped = turns.groupBy("tree_id", "rank").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "head", "body"))).alias("turns")
    )
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: let(
            a["at"] + F.length(t["head"]),
            lambda start: F.struct(
                (start + F.length(t["body"]) + len(END)).alias("at"),
                F.when(
                    t["role"] == LOSS_ROLE,
                    F.concat(a["spans"], F.array(F.struct(start.alias("start"), (start + F.length(t["body"])).alias("end")))),
                )
                .otherwise(a["spans"])
                .alias("spans"),
            ),
        ),
        lambda a: a["spans"],
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return grouped.select("tree_id", "rank", whole.alias("formatted"), spans.alias("loss_spans"), F.size("turns").cast("long").alias("n_turns"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (array of role, text) and ``loss_texts``, parsed from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p != "")
    head = r"(?s)^<\|((?:[^\\|]|\\.)*)\|>\n(.*)$"
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )
    loss = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)


def threads(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the one before it.

    Rows of one conv_id are ordered by turn, then role and text, so repeated
    rows stay and follow each other; a message's score is its length.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    key = lambda n: F.struct(F.col("conv_id"), n.alias("n"))
    return rows.select(
        F.col("conv_id").alias("tree_id"),
        key(F.col("n")).alias("msg_id"),
        F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent_id"),
        F.length("text").alias("score"),
        "role",
        "text",
    )
