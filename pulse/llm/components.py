"""Connected components of a link table, entirely as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Rounds of contraction: each node points at its smallest neighbour (or itself), pointers are
    followed to their ends by doubling, links move to the ends and links inside a tree vanish.
    Every round at least halves the nodes that still have links, so the rounds grow with the
    logarithm of the input. Each round is written to the shared folder. Null ends and links of a
    node to itself are ignored; an empty table gives an empty result.
    """
    edges = stage_table(
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = stage_table(both.groupBy("u").agg(F.min("v").alias("v"))
                              .select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage_table(parents.join(up, "root")
                                 .select("node", F.col("next").alias("root"),
                                         (F.col("next") != F.col("root")).alias("moved")), "jumped")
            parents = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stage_table(labels.join(step, "root", "left")
                                 .select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = parents.select("node", "root")
        edges = stage_table(
            edges.join(ends.toDF("u", "ru"), "u").join(ends.toDF("v", "rv"), "v")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .filter("u != v").distinct(), "links")
    return labels
