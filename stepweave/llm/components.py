"""Connected components of an edge table by hooking and contraction, in DataFrame functions only.

In each round every node hooks to the smallest node among itself and its neighbours, parents are followed twice more, and
the edges are rewritten to the parents; what is left is a smaller graph with the same components. Node ids have to be
hashes: with ids in random order chains of falling ids are short, a fixed share of the nodes goes in each round,
and the rounds number about the logarithm of the nodes whatever the graph looks like. Minima are summed up before they
are shuffled, so a node with very many neighbours costs one row for each task; joins on such a node can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, label) for each node of edges (a, b: long); the label is one node of the component.

    Loops and repeated edges do no harm; a null end drops the edge. No edges: no rows.
    """
    now = store(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        for _ in range(jumps):
            over = hooks.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            hooks = hooks.join(over, hooks["up"] == over["mid"]).select("node", F.col("top").alias("up"))
        hooks = store(hooks, "hooks")
        one, two = (hooks.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b"))
        rest = now.join(one, "a").join(two, "b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        rest = store(rest.where("a <> b").distinct(), "edges")
        discard(now)
        rounds.append(hooks)
        now = rest
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = rounds[0].select("node", F.col("up").alias("label"))
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        out = out.join(step, out["label"] == step["mid"], "left").select("node", F.coalesce("top", "label").alias("label"))
    return out
