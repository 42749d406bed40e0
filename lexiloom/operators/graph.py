"""Is-a graphs over edge tables: closure, grouping under nearest roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import cut, meet
from .ordering import running_number

DEPTH = 5


def descendants(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(root, node, depth)``: nodes below each root, nearest depth first seen, ``depth`` steps at most.

    ``edges`` has ``child`` and ``parent``, ``roots`` has ``root``. Each step joins the frontier only
    and drops what was seen, so cycles end; steps are cut in the shared folder.
    """
    e = edges.filter("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    seen = cut(roots.filter("root is not null").select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["parent"]).select("root", F.col("child").alias("node")).distinct()
        frontier = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def parents(edges: DataFrame) -> DataFrame:
    """``(root)``: every concept that has a child other than itself, once."""
    return edges.filter("child is not null and parent is not null and child <> parent").select(F.col("parent").alias("root")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, parents, kind)``: ``root`` without parents, ``new_root`` with several, ``child`` with one."""
    e = edges.filter("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    nodes = e.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    up = e.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("parents"))
    n = nodes.join(up, "node", "left").withColumn("parents", F.coalesce("parents", F.lit(0)))
    return n.withColumn("kind", F.when(F.col("parents") == 0, "root").when(F.col("parents") == 1, "child").otherwise("new_root"))


def group_under_roots(edges: DataFrame) -> DataFrame:
    """``(node, kind, head, steps)``: each child under the nearest root or new root on its only way up.

    Pointer jumping: in each round a child's pointer takes over the pointer of the node it points
    at, so a way of any length ends after as many rounds as its length has bits. A round that brings
    nobody to a head leaves only children on or under a cycle, which are their own heads at -1 steps.
    """
    e = edges.filter("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    kinds = cut(degrees(edges))
    heads = kinds.filter("kind <> 'child'").select("node")
    up = kinds.filter("kind = 'child'").select("node").join(e, F.col("node") == F.col("child")).select("node", F.col("parent").alias("at"), F.lit(1).cast("bigint").alias("steps"))
    walk = cut(meet(up, heads.select(F.col("node").alias("at"), F.lit(True).alias("done")), ["at"], "left").withColumn("done", F.coalesce("done", F.lit(False))))
    left = walk.filter("not done").count()
    while left:
        # arrived pointers stay as they are and are only read
        ahead = walk.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("there"))
        moved = meet(walk.filter("not done").drop("done"), ahead, ["at"]).select("node", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        walk = cut(walk.filter("done").select("node", "at", "steps", "done").unionByName(moved))
        before, left = left, walk.filter("not done").count()
        if left == before:
            break
    child = F.lit("child").alias("kind")
    arrived = walk.filter("done").select("node", child, F.col("at").alias("head"), "steps")
    lost = walk.filter("not done").select("node", child, F.col("node").alias("head"), F.lit(-1).cast("bigint").alias("steps"))
    return kinds.filter("kind <> 'child'").select("node", "kind", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("steps")).unionByName(arrived).unionByName(lost)


def group_numbers(grouped: DataFrame) -> DataFrame:
    """``grouped`` with ``group_id``: heads are numbered from 1 in the order of their names, their
    members inherit the number; nodes on cycles, which have no head, get 0."""
    heads = running_number(grouped.filter("steps = 0").select(F.col("node").alias("head")), [F.asc("head")], "group_id")
    return meet(grouped, cut(heads), ["head"], "left").withColumn("group_id", F.when(F.col("steps") < 0, 0).otherwise(F.col("group_id")).cast("bigint"))


def group_kinds(grouped: DataFrame) -> DataFrame:
    """``(group_id, members, children, kind)`` of each group: ``single`` for a head alone, else its head's kind."""
    by = grouped.filter("group_id > 0").groupBy("group_id").agg(F.count("*").alias("members"), F.count_if(F.col("kind") == "child").alias("children"), F.max(F.when(F.col("steps") == 0, F.col("kind"))).alias("head_kind"))
    return by.select("group_id", "members", "children", F.when((F.col("members") == 1) & (F.col("head_kind") == "root"), "single").otherwise(F.col("head_kind")).alias("kind"))


def unpack_edges(rows: DataFrame, packed: str, pair_sep: str = ";", part_sep: str = ",") -> DataFrame:
    """``(child, parent)`` from a string of packed pairs; the parent ``null`` states a vertex without edge.

    Repeated pairs count once; pairs without a child are left out.
    """
    p = rows.select(F.explode(F.split(packed, f"[{pair_sep}]")).alias("p")).select(F.split("p", f"[{part_sep}]").alias("x"))
    parent = F.trim(F.get("x", F.lit(1)))
    return p.select(F.trim(F.get("x", F.lit(0))).alias("child"), F.when(parent != "null", parent).alias("parent")).filter("child <> ''").distinct()


def split_new_roots(edges: DataFrame, copies: bool = False) -> DataFrame:
    """``(child, parent)`` where no node has two parents: the edges of a new root are cut.

    With ``copies`` each of them gets a copy of the vertex, named after the parent, instead.
    """
    e = edges.filter("child is not null and parent is not null and child <> parent").select("child", "parent").distinct()
    kinds = cut(e.groupBy("child").agg(F.count("*").alias("n")))
    j = meet(e, kinds, ["child"])
    if not copies:
        return j.filter("n = 1").select("child", "parent")
    return j.select(F.when(F.col("n") > 1, F.concat("child", F.lit("@"), "parent")).otherwise(F.col("child")).alias("child"), "parent")


def layers(edges: DataFrame) -> DataFrame:
    """``(node, layer)``: 0 for nodes without parents, else one more than the highest parent; -1 on and
    below cycles.

    Layer by layer, a node comes once all its parents have: a round joins the newest layer only. A
    graph has as many rounds as layers.
    """
    e = cut(edges.filter("child is not null and parent is not null and child <> parent").select("child", "parent").distinct())
    nodes = cut(degrees(e).select("node", "parents"))
    newest = nodes.filter("parents = 0").select("node")
    done = cut(newest.withColumn("layer", F.lit(0)))
    waiting = cut(nodes.filter("parents > 0"))
    k = 0
    while not newest.isEmpty():
        k += 1
        come = newest.join(e, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.count("*").alias("come"))
        left = cut(meet(waiting, cut(come), ["node"], "left").select("node", (F.col("parents") - F.coalesce("come", F.lit(0))).alias("parents")))
        newest = left.filter("parents = 0").select("node")
        done = cut(done.unionByName(newest.withColumn("layer", F.lit(k))))
        waiting = left.filter("parents > 0")
    return done.unionByName(waiting.select("node", F.lit(-1).alias("layer")))


def relays(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """``(child, parent, relays)``: how many vertices an edge needs in the layers that it passes."""
    low, high = placed.select(F.col("node").alias("child"), F.col("layer").alias("lc")), placed.select(F.col("node").alias("parent"), F.col("layer").alias("lp"))
    j = edges.select("child", "parent").distinct().join(low, "child").join(high, "parent").filter("lc > 0 and lp >= 0")
    return j.select("child", "parent", (F.col("lc") - F.col("lp") - 1).alias("relays"))
