"""Connected components by randomised contraction: a logarithmic number of rounds on a shrinking edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge with two different ends; component is the smallest node reachable.

    In each round every node moves onto the neighbour (or itself) of lowest hashed priority, the edges are
    renamed and self-loops and repeats go. Priorities change with the round, so paths shrink as fast as stars.
    Nothing reaches the driver but whether edges are left. Null ends and self-loops are ignored; an empty
    edge table gives an empty result.
    """
    pairs = lambda x, y: (F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    live = save(edges.where(F.col(a) != F.col(b)).select(*pairs(F.col(a), F.col(b))).distinct(), "edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("p"), F.col(c).alias("v"))
        ends = live.select(F.col("lo").alias("node"), order("hi").alias("to")).unionAll(live.select(F.col("hi").alias("node"), order("lo").alias("to")))
        best = ends.groupBy("node").agg(F.min("to").alias("to"))
        move = save(best.select("node", F.least(order("node"), F.col("to"))["v"].alias("up")), "moves")
        moves.append(move)
        low, high = move.select(F.col("node").alias("lo"), F.col("up").alias("x")), move.select(F.col("node").alias("hi"), F.col("up").alias("y"))
        live = save(live.join(low, "lo").join(high, "hi").where("x <> y").select(*pairs(F.col("x"), F.col("y"))).distinct(), "edges")
    if not moves:
        return live.select(F.col("lo").alias("node"), F.col("hi").alias("component"))
    roots = moves[-1].select("node", F.col("up").alias("root"))
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("up"), "root")
        roots = save(move.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    return roots.join(save(least, "least"), "root").select("node", "component")


class Forest:
    """Union-find over the links that a task sees: grown() tells which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def grown(self, a: list[int], b: list[int]) -> list[bool]:
        new = []
        for x, y in zip(a, b, strict=True):
            x, y = self.root(x), self.root(y)
            new.append(x != y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
        return new
