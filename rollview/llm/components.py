"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links that a task joins at once, in some tens of MB.
PER_TASK = 200_000


def components(links: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, component) of every node that ``links`` (a, b) tie to another; a component is named by its smallest node.

    Rounds of two steps. First the links are dealt to tasks, ``per_task`` each, and a task passes on a forest of its links, every
    node linked to the smallest of its tree. If one task held all that were left, this ends it. Else each node takes the node that
    a hash puts first among itself and its neighbours, and the links are carried over to the nodes taken; those that tie a node
    to itself go. Nodes and links fall by a share each round, so all rounds together cost little more than the first. Names are
    handed back through the rounds from the last one on. Links and names stay in tables, each round's are written to the
    checkpoint folder, and the driver only learns how many links are left; no step puts a component into one task.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    left, rounds = cut(links.select("a", "b").where("a <> b")), []
    while n := left.count():
        tasks = -(-n // per_task)
        forest = cut(left.repartition(tasks).mapInArrow(_forest, "a long, b long"))
        if tasks == 1:
            rounds.append(forest.select(F.col("a").alias("node"), F.col("b").alias("taken")))
            break
        both = forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        rounds.append(cut(best.select(F.col("a").alias("node"), F.least("best", rank("a")).getField("n").alias("taken"))))
        ends = rounds[-1].select(F.col("node").alias("a"), F.col("taken").alias("x")), rounds[-1].select(F.col("node").alias("b"), F.col("taken").alias("y"))
        left = cut(forest.join(ends[0], "a").join(ends[1], "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if len(rounds) == 1 and tasks == 1:  # the roots are the smallest already
        return rounds[0].select("node", F.col("taken").alias("component"))
    named = rounds.pop().select("node", F.col("taken").alias("name"))
    while rounds:  # what a later round no longer knows was a component already
        later = cut(named).select(F.col("node").alias("taken"), "name")
        named = rounds.pop().join(later, "taken", "left").select("node", F.coalesce("name", "taken").alias("name"))
    named = cut(named)
    smallest = cut(named.groupBy("name").agg(F.min("node").alias("component")))
    return cut(named.join(smallest, "name").select("node", "component"))


def _forest(batches):
    """Links from every node to the smallest of its tree, that one included."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])
