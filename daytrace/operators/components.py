"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, join_groups


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(v, root)``: the smallest vertex that each vertex can reach.

    Each round takes the smallest label among a vertex's neighbours, then the label's own label, so that long chains
    close in a logarithmic number of rounds. Labels and edges stay in tables; each round is cut by a checkpoint. A vertex
    with a third of all edges, or a label that a third of all vertices share, is met by a broadcast of the few such.
    Vertices that are in no edge have no row. Loops and repeated edges do no harm.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root"), F.count(F.lit(1)).alias("n")))
    n_edges, n_vertices = both.count(), labels.count()
    while n_edges:
        near = join_groups(both, labels.withColumnRenamed("v", "b"), ["b"], "n", n_edges).groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        hooked = cut_lineage(labels.join(near, "v").select("v", "n", F.col("root").alias("old"), F.least("root", "near").alias("hook")))
        sizes = hooked.groupBy("hook").agg(F.count(F.lit(1)).alias("k"))
        jump = cut_lineage(hooked.select(F.col("v").alias("hook"), F.col("hook").alias("root")).join(sizes, "hook"))
        new = cut_lineage(join_groups(hooked, jump, ["hook"], "k", n_vertices).select("v", "n", "root", (F.col("root") != F.col("old")).alias("moved")))
        labels = new.select("v", "root", "n")
        if new.filter("moved").isEmpty():
            break
    return labels.select("v", "root")


def spanning(edges: DataFrame, held: int = 1_000_000) -> DataFrame:
    """Fewer edges ``a, b`` that connect the same vertices: each partition keeps one edge for each vertex that it links to a
    smaller one. A task holds ``held`` edges and what it kept so far."""

    def task(batches):
        kept, waiting, n = np.zeros((2, 0), np.int64), [], 0
        for batch in batches:
            waiting.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= held:
                kept, waiting, n = star(np.concatenate([kept, *waiting], axis=1)), [], 0
        kept = star(np.concatenate([kept, *waiting], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["a", "b"])

    def star(ends):
        names, at = np.unique(ends, return_inverse=True)
        (u, v), root = at.reshape(ends.shape), np.arange(len(names))
        while True:
            x, y = root[u], root[v]
            apart = x != y
            if not apart.any():
                far = root != np.arange(len(names))
                return np.stack([names[far], names[root[far]]])
            u, v = u[apart], v[apart]
            np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (root[root] != root).any():
                root = root[root]

    return edges.select("a", "b").mapInArrow(task, "a long, b long")
