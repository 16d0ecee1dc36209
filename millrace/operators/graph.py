"""Connected components: links are contracted in their tasks, then minimum labels spread along what is left, with pointer jumping, until nothing changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

#: Nodes that one task holds at a time while it contracts links; what is known by then goes out as links.
HELD = 200_000


def contract(links: DataFrame, held: int = HELD) -> DataFrame:
    """u, v: links with the same components as ``links`` (u, v), one for each node of a task at most: to the smallest node that the task's links reach."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches):
        parent: dict = {}

        def top(x):
            root = x
            while root in parent:
                root = parent[root]
            while x != root:
                parent[x], x = root, parent[x]
            return root

        def out():
            nodes = list(parent)
            arrays = [pa.array(nodes), pa.array([top(x) for x in nodes])] if nodes else [pa.array([], b_type)] * 2
            return pa.RecordBatch.from_arrays([x.cast(b_type) for x in arrays], ["u", "v"])

        b_type = pa.null()
        for b in batches:
            b_type = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            if len(parent) > held:
                yield out()
                parent.clear()
        if parent:
            yield out()

    return links.mapInArrow(run, f"u {kind}, v {kind}")


def component_labels(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node and root (smallest node of its component) for every node of a link.

    Each task first reduces its links to one for each of its nodes.  A round then takes each node's smallest label
    among its neighbours, then the label's own label; two shuffles of narrow rows. Tables between rounds are written
    to the shared folder.  Null ends and links of a node with itself are ignored.
    """
    e = contract(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    e = staged(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = e.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("r"))
        up = labels.select(F.col("node").alias("r"), F.col("root").alias("r2"))
        new = staged(step.join(up, "r", "left").select("node", "old", F.least("r", F.coalesce("r2", "r")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("old <> root").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
