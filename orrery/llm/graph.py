"""Connected components of a links table, without any of it on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the least node: the same components, at most a link for each node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_pydict({"a": pa.array([root(x) for x in nodes], pa.int64()), "b": pa.array(nodes, pa.int64())})


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the least node that is reachable.

    Each round every node points to its least neighbour, pointers jump until they stand on roots, and links are drawn
    again between roots. Roots that still have a link at least halve in number each round.
    """
    links = scratch.keep(links.mapInArrow(_forest, "a long, b long").distinct(), f"{name}-links-0")
    found, step = None, 0
    while True:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        points, jump = scratch.keep(points, f"{name}-points-{step}-0"), 0
        while True:
            jump += 1
            up = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            points = scratch.keep(points.select("node", "root").join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), f"{name}-points-{step}-{jump}")
            if points.filter("moved").isEmpty():
                break
        points = points.select("node", "root")
        if found is None:
            found = points.withColumnRenamed("root", "component")
        else:
            up = points.select(F.col("node").alias("component"), "root")
            found = found.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        a, b = (points.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        step += 1
        roots = links.join(a, "a").join(b, "b").filter("a_root <> b_root")
        links = scratch.keep(roots.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), f"{name}-links-{step}")
        if links.isEmpty():
            return scratch.keep(found, f"{name}-components")
