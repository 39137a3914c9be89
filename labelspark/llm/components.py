"""Connected components of a graph given as edges, as Spark jobs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import map_arrow
from labelspark.session import settle

CHUNK_EDGES = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for the nodes of the edges a–b."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Replace the edges of each chunk by a star per component of the chunk."""
    held_a, held_b, held = [], [], 0

    def star():
        node, low = smallest_reachable(np.concatenate(held_a), np.concatenate(held_b))
        far = node != low
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(low[far])], ["u", "v"])

    for batch in batches:
        held_a.append(batch.column(0).to_numpy())
        held_b.append(batch.column(1).to_numpy())
        held += len(held_a[-1])
        if held >= CHUNK_EDGES:
            yield star()
            held_a, held_b, held = [], [], 0
    if held:
        yield star()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v) with u > v."""
    sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    lows = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = sides.join(lows, "u")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            lows.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node that has an edge to another, the smallest node
    it reaches. ``edges``: two bigint columns u, v, in any order, repeats allowed.

    Chunks of edges are first contracted inside their tasks, then large-star and
    small-star steps alternate until nothing changes. Each round is written to
    the shared folder. Both sides of an edge travel by equality joins with one
    row per node on the other side, so a hub is split by the skew join.
    """
    edges = edges.filter(F.col("u") != F.col("v"))
    edges = settle(map_arrow(edges, _contract, "u long, v long").distinct(), "edges")
    state = None
    while True:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state or not row[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
        edges = settle(_star(_star(edges, True), False), "edges")
