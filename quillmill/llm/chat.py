"""Chat formatting: reply trees to conversations with a reversible template and a loss mask.

Native DataFrame code only. Root-to-leaf paths come from iterative self-joins with pointer
doubling: after k rounds a leaf knows its last 2**k nodes, so a tree of depth d takes log2(d)
rounds and one row per path member, never an array per node. Branches are ranked by their mean
node score and the best of each tree are formatted, one conversation a path.

Template: ``<s>`` once, then ``[INST] role [/INST] text</s>`` for each turn. Control strings
inside roles and texts get a backslash after their first character and backslashes are doubled,
so that a formatted conversation is read back exactly.

Nulls and corner cases: null text and null role are empty; null turns come first, rows with equal
turns are ordered by role, then text; a null conversation id is one conversation; an empty table
gives no rows. A conversation is one output row, so its turns meet in one task. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, stored

BEGIN, ROLE, TEXT, END = "<s>", "[INST] ", " [/INST] ", "</s>"
CONTROLS = ("[INST]", "[/INST]", "</s>", "<s>")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for x in CONTROLS:
        c = F.replace(c, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for ``nodes`` (tree, node, parent): the members of each root-to-leaf path.

    ``up`` counts the steps from the leaf. A parent that is not in the tree makes its child a
    root. Node ids are unique within a tree; a cycle has no leaf and so gives no path.
    """
    nodes = stored(nodes.select("tree", "node", "parent"), "chat-nodes")
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = nodes.alias("n").join(parents.alias("p"), same("n", "p") & (F.col("n.node") == F.col("p.node")), "left_anti")
    member = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = nodes.alias("a").join(nodes.alias("b"), same("a", "b") & (F.col("a.parent") == F.col("b.node"))).select("a.tree", "a.node", F.col("b.node").alias("far"))
    step = 1
    while True:
        jump = stored(jump, "chat-jump")
        more = member.alias("m").join(jump.alias("j"), same("m", "j") & (F.col("m.node") == F.col("j.node"))).select("m.tree", "m.leaf", F.col("j.far").alias("node"), (F.col("m.up") + step).alias("up"))
        if jump.isEmpty():
            return member
        member = stored(member.unionByName(more), "chat-paths")
        jump = jump.alias("a").join(jump.alias("b"), same("a", "b") & (F.col("a.far") == F.col("b.node"))).select("a.tree", "a.node", "b.far")
        step *= 2
        if step > 1 << 40:
            raise ValueError("reply links run in a cycle")


def format_trees(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, score, n_turns, formatted, loss_spans) of the ``best`` branches of each tree.

    ``nodes``: tree, node, parent, role, text, score (null: 0). ``loss_spans`` are (start, length)
    in code points of ``formatted``: the assistant texts, which is all that a loss would see.
    """
    body = nodes.select("tree", "node", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("learn"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    member = paths(nodes)
    scored = member.alias("m").join(body.alias("b"), F.col("m.tree").eqNullSafe(F.col("b.tree")) & (F.col("m.node") == F.col("b.node"))).select("m.tree", "m.leaf", "m.up", "b.role", "b.text", "b.learn", "b.score")
    rank = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    chosen = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= best)
    kept = scored.alias("s").join(chosen.alias("c"), F.col("s.tree").eqNullSafe(F.col("c.tree")) & (F.col("s.leaf") == F.col("c.leaf"))).select("s.*", "c.branch_score")
    head = F.concat(F.lit(ROLE), F.col("role"), F.lit(TEXT))
    turn = F.concat(head, F.col("text"), F.lit(END))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("turn", turn).withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + len(BEGIN) + F.length(head))
    whole = placed.groupBy("tree", "leaf", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "learn", "start", F.length("text").alias("length")))).alias("turns"))
    return whole.select(
        "tree", "leaf", F.col("branch_score").alias("score"), F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["turn"]), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    raw = F.filter(F.split(F.substr(formatted, F.lit(len(BEGIN) + 1)), END, -1), lambda x: x != "")
    return F.transform(raw, lambda x: F.struct(unescape(F.substr(F.substring_index(x, TEXT, 1), F.lit(len(ROLE) + 1))).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"]))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    talks = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = format_trees(chains(talks))
    read = done.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(c: str) -> str:
    c = rf"replace({c}, '\', '\\')"
    for x in CONTROLS:
        c = f"replace({c}, '{x}', '{x[0]}\\{x[1:]}')"
    return c


OP1_SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (3 + sum(7 + length({_sql_escape("role")}) + 9 + length({_sql_escape("text")}) + 4))::bigint as formatted_chars
from t group by conv_id
"""
