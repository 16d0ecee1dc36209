"""Connected components of a link table, as DataFrame joins: every node gets the smallest node that it reaches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged


def _contract(batches):
    """Links of one task become links to the smallest node that the task's links reach."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 500_000:  # bounded memory: what is known so far goes out as links
            yield _links(parent, find)
            parent.clear()
    yield _links(parent, find)


def _links(parent, find):
    nodes = list(parent)
    return pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.int64)), pa.array(np.array([find(x) for x in nodes], np.int64))], ["v", "r"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` that is not itself the smallest of its component.

    Each round gives a node its smallest known partner as parent, links its other
    partners to that parent, and replaces parents by their own parents, until every
    node has one parent that is a root.  Hot nodes are safe: minima are aggregated before
    the shuffle, and joins of links to minima are joins that AQE splits.
    Null nodes and self links are ignored.
    """
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = staged(e.mapInArrow(_contract, "v long, r long"), "links")
    for _ in range(max_rounds):
        parents = staged(e.groupBy("v").agg(F.min("r").alias("p"), F.count_distinct("r").alias("n")), "parents")
        stop = parents.where("n > 1").limit(1).count() == 0 and e.join(parents.select(F.col("v").alias("r")), "r", "left_semi").limit(1).count() == 0
        if stop:
            return parents.select(F.col("v").alias("node"), F.col("p").alias("root"))
        up = parents.select(F.col("v").alias("w"), "p")
        hooked = e.join(up, F.col("v") == F.col("w")).select(F.explode(F.array(F.struct("v", F.col("p").alias("r")), F.struct(F.col("r").alias("v"), F.col("p").alias("r")))).alias("x")).select("x.*").where("v <> r")
        jumped = hooked.join(up, F.col("r") == F.col("w"), "left").select("v", F.coalesce("p", "r").alias("r"))
        e = staged(jumped.distinct(), "links")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
