"""Hierarchies stored as (id, parent_id), expanded by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize

c = F.col


def _jumped(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Every node once, with its way to the top and the nodes below it; whether some nodes have no top.

    After r rounds a node knows its ancestor 2^r steps above (``jump``, null once
    the way is complete), the labels up to there and how many nodes lie less than
    2^r steps below it. A round joins each node with the one it points to and adds
    the sizes that point to it, so it writes one row per node, and a hierarchy of
    depth d takes log2(d) rounds. Every node above the deepest one has another
    depth, so each round completes some as long as any can be completed: a round
    that completes none leaves only nodes on a cycle or below one.
    """
    open_ = nodes.filter("jump is not null").count()
    while open_:
        moving = nodes.filter("jump is not null")
        above = nodes.select(c("id").alias("jump"), c("jump").alias("next"), c("hops").alias("more_hops"), c("trail").alias("up"))
        moved = moving.join(above, "jump").select(
            "id", c("next").alias("jump"), (c("hops") + c("more_hops")).alias("hops"), F.concat_ws(" > ", "up", "trail").alias("trail"), "size")
        gained = moving.groupBy(c("jump").alias("id")).agg(F.sum("size").alias("gained"))
        whole = moved.unionByName(nodes.filter("jump is null")).join(gained, "id", "left")
        nodes = materialize(whole.select("id", "jump", "hops", "trail", (c("size") + F.coalesce("gained", F.lit(0))).alias("size")), "tree")
        before, open_ = open_, nodes.filter("jump is not null").count()
        if open_ == before:
            return nodes, True
    return nodes, False


def tree_expand(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", label: str = "label") -> DataFrame:
    """Depth, root-to-node path, leaf flag, subtree size, orphan flag and cycle flag per node.

    A node whose parent is not among the nodes is an orphan and starts a tree of its
    own. A node on a cycle, or below one, has ``is_cycle`` and neither depth, path
    nor subtree size. Ids are unique; a null label leaves its place in the path out.
    """
    base = nodes.select(c(id_col).alias("id"), c(parent_col).alias("parent_id"), c(label).alias("label"))
    ids = base.select(c("id").alias("parent_id"), c("id").alias("jump"))
    start = base.filter("parent_id is not null").join(ids, "parent_id", "left").unionByName(
        base.filter("parent_id is null").withColumn("jump", c("parent_id")))
    start = materialize(start.select("id", "jump", F.lit(1).cast("bigint").alias("hops"), c("label").alias("trail"),
                                     F.lit(1).cast("bigint").alias("size")), "tree")
    done, cyclic = _jumped(start)
    parents = base.select(c("parent_id").alias("id")).filter("id is not null").distinct().withColumn("has_child", F.lit(True))
    topped = F.col("jump").isNull() if cyclic else F.lit(True)
    roots = start.filter("jump is null").select("id", F.lit(True).alias("top"))
    return (base.join(done, "id").join(parents, "id", "left").join(roots, "id", "left")
            .select("id", "parent_id", "label", F.when(topped, c("hops") - 1).alias("depth"), F.when(topped, c("trail")).alias("path"),
                    c("has_child").isNull().alias("is_leaf"), F.when(topped, c("size")).alias("subtree_size"),
                    (c("parent_id").isNotNull() & c("top").isNotNull()).alias("is_orphan"), (~topped).alias("is_cycle")))
