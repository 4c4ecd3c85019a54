"""Chat formatting from reply trees, in DataFrame functions only.

Root-to-leaf paths come from self-joins: jump tables double the distance to an
ancestor each round, so a tree of depth d takes log2(d) rounds. Walking leaves
up through the tables from the widest down sums the scores of each path, one
row a leaf; expanding the chosen leaves the same way yields each chosen path
once. Only narrow keys take part; texts join the chosen paths alone.

The template marks a turn as ``<|turn|>role\\ntext<|end|>``. Control strings
inside texts get one backslash after their first character, more where there
are some already, so that escaping can be undone and no escaped text holds one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.plans.scratch import Scratch

TURN, END = "<|turn|>", "<|end|>"
#: Roles whose texts are learnt.
LOSS_ROLES = ("assistant",)
#: A control string is < or [ with one of these rests: its own marks and those of common templates.
REST = r"(\||/?s>|<SYS>>|</SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + REST, r"$1$2$3")


def escape_role(role: Column) -> Column:
    """A role stays on its line and holds no marks."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column) -> Column:
    """One string of an array<struct<role, text>>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))), "")


def turn_lengths(role: Column, text: Column) -> tuple[Column, Column]:
    """Code points of a rendered turn before its text, and of its escaped text."""
    return F.length(escape_role(role)) + (len(TURN) + 1), F.length(escape(text))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under a loss mask, unescaped, one after another."""
    return F.array_join(F.transform(spans, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> back from a rendered string."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring(p, F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substring(body(p), cut(p) + 1, F.length(p))).alias("text")))


def best_paths(nodes: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, dist) for every node of the ``top`` best paths of each tree; dist counts from the leaf.

    nodes(tree, node, parent, score) has unique (tree, node). A parent that is
    not in the tree makes a root. Nodes whose ancestors run in a circle have no
    root and give no path.

    Each jump carries the scores it passes, so a leaf learns its path's mean in
    one row, and only the chosen paths are written out node by node.
    """
    known = nodes.select("tree", F.col("node").alias("anc"))
    own = [F.coalesce("score", F.lit(0.0)).alias("sum"), F.col("score").isNotNull().cast("long").alias("n")]
    jump = scratch.save(nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("anc"), *own).join(known, ["tree", "anc"], "left_semi").select("tree", "node", "anc", "sum", "n"))
    leaves = nodes.select("tree", "node").join(jump.select("tree", F.col("anc").alias("node")), ["tree", "node"], "left_anti")
    rounds = math.ceil(math.log2(max(2, nodes.count()))) + 1
    jumps = [jump]
    while jumps[-1].take(1):
        if len(jumps) > rounds:  # what still has an ancestor so far up is in or under a circle
            leaves = leaves.join(jumps[-1].select("tree", "node"), ["tree", "node"], "left_anti")
            break
        a, b = jumps[-1], jumps[-1].select("tree", F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("sum").alias("more"), F.col("n").alias("m"))
        jumps.append(scratch.save(a.join(b, ["tree", "anc"]).select("tree", "node", F.col("far").alias("anc"), (F.col("sum") + F.col("more")).alias("sum"), (F.col("n") + F.col("m")).alias("n"))))
    steps = [jumps[k].select("tree", F.col("node").alias("at"), "anc", F.col("sum").alias("more"), F.col("n").alias("m")) for k in range(len(jumps) - 1)]
    way = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    none = [F.coalesce("more", F.lit(0.0)), F.coalesce("m", F.lit(0))]
    for step in reversed(steps):
        way = scratch.save(way.join(step, ["tree", "at"], "left").select("tree", "leaf", F.coalesce("anc", "at").alias("at"), (F.col("sum") + none[0]).alias("sum"), (F.col("n") + none[1]).alias("n")))
    root = nodes.select("tree", F.col("node").alias("at"), *[c.alias(name) for c, name in zip(own, ("more", "m"))])
    score = F.try_divide(F.col("sum") + F.col("more"), (F.col("n") + F.col("m")).cast("double"))
    # a leaf's rank is asked for up to ``top`` only, which Spark settles within each task before the shuffle
    order = W.partitionBy("tree").orderBy(F.col("score").isNull(), (-F.col("score")).asc(), "leaf")
    ranked = way.join(root, ["tree", "at"]).select("tree", "leaf", score.alias("score")).withColumn("rank", F.row_number().over(order))
    found = scratch.save(ranked.filter(F.col("rank") <= top).select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist")))
    for k in reversed(range(len(steps))):
        step = steps[k].select("tree", F.col("at").alias("node"), "anc")
        found = scratch.save(found.union(found.join(step, ["tree", "node"]).select("tree", "leaf", "rank", "score", F.col("anc").alias("node"), (F.col("dist") + (1 << k)).alias("dist"))))
    return found


def format_trees(nodes: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """The ``top`` best paths of each tree, each as one row (tree, leaf, rank, score, formatted, loss).

    ``loss`` is the loss mask: (start, length) in code points of the escaped text
    of each turn of a role in LOSS_ROLES, in order.

    nodes(tree, node, parent, role, text, score): null roles and texts count as
    empty, null trees as one tree of their own, null nodes are dropped. Of rows
    that share (tree, node) the smallest by (parent, role, text, score) stays.
    A path's score is the mean of its nodes' scores that are not null; paths go
    by score (null last), then by leaf. Other columns are ignored; an empty
    table gives none.
    """
    own = nodes.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))).alias("x"))
    # a key that joins null trees too
    own = scratch.save(own.select(F.to_json(F.struct("tree")).alias("key"), "tree", "node", "x.*"))
    way = best_paths(own.select(F.col("key").alias("tree"), "node", "parent", "score"), scratch, top).withColumnRenamed("tree", "key")
    chosen = way.join(own.select("key", "node", "tree", "role", "text"), ["key", "node"])
    head, size = turn_lengths(F.col("role"), F.col("text"))
    before = W.partitionBy("key", "leaf").orderBy(F.col("dist").desc()).rowsBetween(W.unboundedPreceding, -1)
    chosen = chosen.withColumns({"_head": head, "_size": size})
    chosen = chosen.withColumn("_start", F.coalesce(F.sum(F.col("_head") + F.col("_size") + len(END)).over(before), F.lit(0)) + F.col("_head"))
    row = F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text", F.col("_start").cast("int").alias("start"), F.col("_size").alias("length"))))
    out = chosen.groupBy("key", "leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"), row.alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["role"].isin(*LOSS_ROLES)), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("tree", "leaf", "rank", "score", render(F.col("turns")).alias("formatted"), loss.alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from (tree, formatted, loss): the turns, and the text under the loss mask."""
    df = formatted.select("tree", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    """The digests in DuckDB SQL over `conversations`."""
    rest = r"(\||/?s>|<SYS>>|</SYS>>|/?INST\])"
    esc = lambda x: f"regexp_replace({x}, '([<\\[])(\\\\*){rest}', '\\1\\\\\\2\\3', 'g')"
    role = esc("replace(replace(role, '\\', '\\b'), chr(10), '\\n')")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) w,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') l,
  sum({len(TURN) + len(END) + 1} + length({role}) + length({esc("text")})) f FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) n_turns, sha256(w) turns_sha256, CAST(length(l) AS BIGINT) loss_chars, sha256(l) loss_sha256, CAST(f AS BIGINT) formatted_chars FROM g"""
