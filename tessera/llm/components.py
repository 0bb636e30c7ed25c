"""Connected components of a graph given as an edge table.

Edges are contracted inside each partition first. Graphs of up to ``ONE_TASK_EDGES`` edges are then finished by one
executor task, a bound that is checked; larger ones by alternating large-star and small-star rounds, which keep every
step an aggregation or a join by node. Nothing goes to the driver but row counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import removed, written

ONE_TASK_EDGES = 2_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of these edges that are not least themselves."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (hop := new[new]).tobytes() != new.tobytes():
            new = hop
        if (new[label] == label).all() and (new == label).all():
            break
        label = new[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 1_000_000:
            a, b = _roots(a, b)
    a, b = _roots(a, b)
    for k in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]), pa.array(b[k : k + 100_000])], ["a", "b"])


def components(edges: DataFrame, most: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge that is not its component's least.

    ``edges`` has two long columns; direction, repeats and loops do not matter; nulls are ignored.
    """
    pairs = edges.toDF("a", "b").where("a is not null and b is not null and a <> b")
    now, path = written(pairs.mapInArrow(_contract, "a long, b long"), "edges")
    count = now.count()
    if count <= most:
        return written(now.coalesce(1).mapInArrow(_contract, "node long, component long"), "components")[0]
    state = None
    while True:
        both = now.union(now.select("b", "a"))  # large star: every neighbour above u joins u's least neighbour
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        step, step_path = written(large, "large-star")
        down = step.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # small star
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s")).select(F.col("s.a").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct()
        new, new_path = written(small, "small-star")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(now.sparkSession, path, step_path)
        now, path = new, new_path
        if tuple(seen) == state:
            return now.toDF("node", "component")
        state = tuple(seen)
