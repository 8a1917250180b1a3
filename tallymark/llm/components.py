"""Connected components of a link table, contracted round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); the component is its smallest node.

    Each round hooks every component to its smallest neighbour, follows the hook
    once more and renames the ends of the links. At least half of the components
    with a link to another one disappear in a round. Links and labels stay in
    tables; the driver only learns whether links are left.
    """
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .filter("a < b").distinct(), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while not links.isEmpty():
        hooks = materialize(links.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new")), "hooks")
        after = hooks.select(F.col("old").alias("new"), F.col("new").alias("next"))
        hooks = materialize(hooks.join(after, "new", "left").select("old", F.coalesce("next", "new").alias("new")), "hooks")

        def renamed(df: DataFrame, column: str) -> DataFrame:
            to = hooks.select(F.col("old").alias(column), "new")
            return df.join(to, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        moved = renamed(renamed(links, "a"), "b")
        links = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                            .filter("a < b").distinct(), "links")
        labels = materialize(renamed(labels, "component"), "labels")
    return labels
