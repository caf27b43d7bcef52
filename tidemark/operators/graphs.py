"""Dependency graphs as tables: components, levels, orders and roll-ups, without tables of all pairs.

Nodes are rows (node), edges rows (src, dst). Repeated edges count once, edges with a null end not at all. A turn of a
loop reads and writes what is left of the graph and no more; its tables go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut_lineage

#: Severities from the least to the worst.
SEVERITY = {"match": 0, "info": 1, "warning": 2, "blocker": 3}
#: Turns of a search whose finds stay in tables of their own before these are written as one.
FOLD = 16


def clean(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs: those who ask for all pairs get as many rows.

    Each turn goes one edge on from the pairs found last. Cycles end it, as no pair is new.
    """
    step = cut_lineage(clean(edges).toDF("ancestor", "descendant"))
    found = last = step
    while not last.isEmpty():
        longer = last.alias("a").join(step.alias("b"), F.col("a.descendant") == F.col("b.ancestor")).select("a.ancestor", "b.descendant").distinct()
        last = cut_lineage(longer.join(found, ["ancestor", "descendant"], "left_anti"))
        found = cut_lineage(found.unionByName(last))
    return found


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out, again and again: no others lie on a cycle."""
    rest, size = cut_lineage(clean(edges).where("src <> dst")), None
    while (now := rest.count()) and now != size:
        size = now
        into, from_ = rest.select(F.col("dst").alias("src")), rest.select(F.col("src").alias("dst"))
        rest = cut_lineage(rest.join(into, "src", "left_semi").join(from_, "dst", "left_semi").select("src", "dst"))
    return rest


def spread(edges: DataFrame, start: DataFrame, from_: str, to: str) -> DataFrame:
    """(node, colour): each node's least colour among its own and those of all from which a path leads to it."""
    colours = cut_lineage(start)
    changed = colours
    while not changed.isEmpty():
        sent = edges.join(changed.toDF(from_, "sent"), from_).groupBy(F.col(to).alias("node")).agg(F.min("sent").alias("sent"))
        after = cut_lineage(colours.join(sent, "node", "left").select("node", F.least("colour", "sent").alias("colour"), (F.col("sent") < F.col("colour")).alias("new")))
        changed = after.where("new").select("node", "colour")
        colours = after.select("node", "colour")
    return colours


def cycles(edges: DataFrame) -> DataFrame:
    """(member, component) of the strongly connected components of more than one node, each named by its least member.

    Nodes without an edge in or out are trimmed. What is left is coloured forwards by the least node that reaches each
    node, then backwards within a colour: nodes that both colours agree on lie on cycles with the node that names it,
    are a component and leave the graph. Every turn settles one component of each colour at least.
    """
    rest = trimmed(edges)
    out = rest.limit(0).toDF("member", "component")
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("node"))
        ahead = spread(rest, nodes.distinct().select("node", F.col("node").alias("colour")), "src", "dst")
        named = rest.join(ahead.toDF("src", "a"), "src").join(ahead.toDF("dst", "b"), "dst")
        within = cut_lineage(named.where("a = b").select("src", "dst", F.col("a").alias("colour")))
        # Backwards from the node that names a colour, along edges of that colour.
        reached = frontier = cut_lineage(ahead.where("node = colour"))
        turn = 0
        while not frontier.isEmpty():
            turn += 1
            back = within.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut_lineage(back.join(reached, ["node", "colour"], "left_anti"))
            reached = reached.unionByName(frontier)
            if turn % FOLD == 0:
                reached = cut_lineage(reached)
        reached = cut_lineage(reached)
        sizes = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found = reached.join(sizes, "colour").select(F.col("node").alias("member"), F.col("colour").alias("component"))
        out = out.unionByName(found)
        # An edge between colours lies on no cycle, and one within a colour to a reached node comes from one.
        rest = trimmed(within.select("src", "dst").join(reached.select(F.col("node").alias("src")), "src", "left_anti"))
    return cut_lineage(out)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the highest of them; nodes on or behind a cycle have none."""
    return levels_found(nodes, edges)[0]


def levels_found(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """Levels, and whether all nodes have one.

    Each turn takes the nodes to which no edge leads any more, with the edges that leave them: a turn a level. Repeated
    edges change nothing, so they stay.
    """
    left, rest = cut_lineage(nodes.select("node").where("node IS NOT NULL").distinct()), cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    out, level = None, 0
    while not left.isEmpty():
        told = cut_lineage(left.join(rest.select(F.col("dst").alias("node")).distinct().withColumn("waits", F.lit(True)), "node", "left"))
        ready, left = told.where("waits IS NULL").select("node"), told.where("waits").select("node")
        if ready.isEmpty():
            break
        rest = cut_lineage(rest.join(ready.toDF("src"), "src", "left_anti"))
        found = ready.withColumn("level", F.lit(level))
        out, level = found if out is None else out.unionByName(found), level + 1
    return (out if out is not None else nodes.select("node").limit(0).withColumn("level", F.lit(0))), left.isEmpty()


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position`` from 1 in the order of columns that tell all rows apart.

    Rows are dealt to ranges and numbered within each; what lies before a range is added. No task sorts more than one.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_at") + 1).cast("int").alias("position"))


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, position) by level and name; empty if the graph has a cycle."""
    found, whole = levels_found(nodes, edges)
    return numbered(found if whole else found.limit(0), "level", "node")


def rank_of(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, r) for s, r in SEVERITY.items()], F.lit(0))


def worst_below(nodes: DataFrame) -> DataFrame:
    """(id, worst) with the worst severity of a node and all below it. Rows: id, parent, severity; unknown severities count as a match.

    Each turn every node passes what it knows to the ancestor that it points to, then points as far again: after n turns
    a node knows all within 2 ** n levels below, so a tree of any depth takes the logarithm of that. Parents that are no
    rows are nodes too. Of rows with one id the worst severity and the least parent count. Nodes of a cycle get the
    worst of it.
    """
    own = nodes.groupBy("id").agg(F.min("parent").alias("up"), F.max(rank_of(F.col("severity"))).alias("rank"))
    kind = nodes.schema["id"].dataType
    above = nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct().join(own.select("id"), "id", "left_anti")
    now = cut_lineage(own.where("id IS NOT NULL").unionByName(above.select("id", F.lit(None).cast(kind).alias("up"), F.lit(0).alias("rank"))))
    turns = max(1, now.count()).bit_length() + 1  # enough for the deepest tree, and an end for cycles
    while turns and not now.where("up IS NOT NULL").isEmpty():
        sent = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.max("rank").alias("sent"))
        farther = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = now.join(farther, "up", "left").select("id", F.col("next").alias("up"), "rank")
        now = cut_lineage(moved.join(sent, "id", "left").select("id", "up", F.greatest("rank", F.coalesce("sent", F.lit(0))).alias("rank")))
        turns -= 1
    return now.select("id", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("rank") + 1).alias("worst"))
