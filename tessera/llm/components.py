"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stash, stash


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is one node of the component.

    In each round every node hooks to its smallest neighbour if that is smaller, the hooks are
    followed to their ends, and links are rewritten to the ends. A round leaves no local minimum
    beside another, so few rounds suffice. Hot nodes meet in aggregations with partial sums only,
    or on the side of a join that Spark can split.
    """
    edges = stash(links.where("a <> b").select("a", "b").distinct(), "cc-links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hooks = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
        hooks = stash(hooks, "cc-hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = stash(hooks.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "cc-jump")
            drop_stash(hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        rounds.append(hooks)
        a, b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        rest = stash(rest, "cc-links")
        drop_stash(edges)
        edges = rest
    if not rounds:
        return stash(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "cc-roots")

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        return found.join(step.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root"))

    roots = stash(reduce(follow, rounds[1:], rounds[0].select("node", "root")), "cc-roots")
    for used in (edges, *rounds):
        drop_stash(used)
    return roots
