"""Chat formatting from reply trees, with DataFrame operations only.

``format_trees`` takes messages of reply trees, enumerates root-to-leaf paths by iterative
self-joins (pointer doubling, so a thread of n turns takes log2(n) rounds), ranks the branches of
each tree by score and formats each chosen path as one conversation.

Template: every turn is ``<|turn:ROLE|>\\nTEXT<|end|>\\n``.  Inside roles and texts ``\\`` becomes
``\\s``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b``; so no control string (they all hold ``<`` or
``[``) can occur inside a text, and the escape is reversible.  Only assistant text carries loss.

Null text or role: empty.  Repeated (conversation, turn) rows: ordered by turn, role, text, and all
kept.  Rows without a conversation id form one conversation of their own, with a null id.  Empty tables: no
rows.  Extra columns are ignored.  A null tree is a tree like others, and a message with a null id is one
that nothing replies to.  A message whose parent is not in the table starts a tree of its own; a
cycle of parents has no root, so it and what replies to it are left out.  Branches are ranked on ids and
scores alone; texts are read for the chosen ones only.  Ties rank by more turns, then by the smaller leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

OPEN, MID, END = "<|turn:", "|>\n", "<|end|>\n"
#: Raw character and its escape, in the order in which escaping applies them.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """messages: tree, id, parent (null at roots), role, text, score; ids are unique within a tree.

    Returns one row per chosen path: tree, leaf, rank (1 is best), n_turns, formatted.  Branches rank
    by the mean score of their messages, then by more turns, then by the smaller leaf.
    """
    # ids in structs, so that null ids are equal to themselves; texts move only when chosen turns are put together
    named = messages.select(
        F.struct("tree").alias("tree"), F.struct("id").alias("id"), F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"))).alias("parent"),
        text_or_empty("role").alias("role"), text_or_empty().alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    nodes = written(named)
    links = nodes.select("tree", "id", "parent")
    known = links.select("tree", F.col("id").alias("parent"))
    jump = written(links.where("parent IS NOT NULL").join(known, ["tree", "parent"]).select("tree", "id", F.col("parent").alias("up")))
    jumps, reach = [jump], 1
    largest = None
    while not jumps[-1].isEmpty():  # jumps[k]: each message and the one 2**k above it
        if largest is None:
            largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
        if reach >= largest:  # more steps up than a tree has messages: these lead into cycles
            endless = written(jumps[-1].select("tree", "id").distinct())
            nodes = written(nodes.join(endless, ["tree", "id"], "left_anti"))
            jumps = [written(j.join(endless, ["tree", "id"], "left_anti")) for j in jumps]
            while len(jumps) > 1 and jumps[-2].isEmpty():
                jumps.pop()
            break
        last = jumps[-1]
        far = last.select("tree", F.col("id").alias("up"), F.col("up").alias("far"))
        jumps.append(written(last.join(far, ["tree", "up"]).select("tree", "id", F.col("far").alias("up"))))
        reach *= 2
    inner = jumps[0].select("tree", F.col("up").alias("id")).distinct()
    path = nodes.select("tree", "id").join(inner, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 2, -1, -1):  # each row stays and also jumps 2**k up: all distances once
        both = F.when(F.col("far").isNull(), F.array(F.struct("id", "up"))).otherwise(F.array(F.struct("id", "up"), F.struct(F.col("far").alias("id"), (F.col("up") + (1 << k)).alias("up"))))
        path = path.join(jumps[k].withColumnRenamed("up", "far"), ["tree", "id"], "left").select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.*")
    path = written(path)
    scored = path.join(nodes.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("n_turns"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("tree", "leaf", "rank", "n_turns")
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(END))
    turns = path.join(chosen, ["tree", "leaf"]).join(nodes.select("tree", "id", piece.alias("piece")), ["tree", "id"])
    # up counts from the leaf: the largest comes first
    pieces = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece"))), lambda x: x["piece"])
    out = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("n_turns").alias("n_turns"), F.array_join(pieces, "").alias("formatted"))
    return out.select("tree.tree", F.col("leaf.id").alias("leaf"), "rank", "n_turns", "formatted")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    at = lambda p: F.instr(p, MID)
    body = lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - (len(OPEN) + 1))).alias("role"),
        unescape(F.substring(p, at(p) + len(MID), F.length(p))).alias("text"),
    )
    return F.transform(pieces, body)


def threads(conversations: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Rows of linear conversations as reply trees: each turn replies to the one before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conversation).alias("tree"), "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added conversation -1 stays apart from one of the table that has the same id."""
    named = lambda added, conv: F.struct(F.lit(added).alias("added"), conv.cast("long").alias("conv_id")).alias("conversation")
    own = table(spark, sf_dir, "conversations").select(named(False, F.col("conv_id")), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(named(True, F.lit(-1)), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = format_trees(threads(own.union(extra), "conversation"))
    turns = formatted.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return turns.select(
        F.col("tree")["conv_id"].alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH r AS (
  SELECT false AS added, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT true, -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT true, -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<|turn:' || replace(replace(replace(role, '\', '\s'), '<', '\l'), '[', '\b') || '|>' || chr(10)
  || replace(replace(replace(text, '\', '\s'), '<', '\l'), '[', '\b') || '<|end|>' || chr(10) AS piece FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length(piece)) AS chars FROM e GROUP BY added, conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""
