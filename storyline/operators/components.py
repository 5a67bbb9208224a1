"""Connected components by label passing with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.session import drop_table, materialize, write_table

#: Edges that a task labels whole, about 100 MB there; more of them are labelled in rounds over the cluster.
TASK_EDGES = 1 << 20


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str], task_edges: int = TASK_EDGES) -> DataFrame:
    """The least id each node can reach: ``keys, id, cluster_id``.

    ``nodes`` has ``keys, id`` and ``edges`` has ``keys, a, b``. Up to ``task_edges`` edges, of all blocks together, are labelled by a task per block.
    Of more, each round a label takes the least label next to it, then the label of its label, so the number of rounds grows with the
    logarithm of the longest chain. The tables of a round are dropped when the next one is written.
    """
    spark = nodes.sparkSession
    edges, written = write_table(edges.select(*keys, "a", "b").filter("a <> b"), "edges")
    if edges.count() <= task_edges:
        return _labelled_in_task(nodes, edges, keys)
    both = edges.select(*keys, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(*keys, F.col("b").alias("id"), F.col("a").alias("other"))
    )
    both = materialize(both.distinct(), "edges")
    drop_table(spark, written)
    labels = nodes.select(*keys, "id", F.col("id").alias("cluster_id"))
    past = None
    while True:
        near = both.join(labels, [*keys, "id"]).select(*keys, F.col("other").alias("id"), "cluster_id")
        least = (
            labels.unionByName(near).groupBy(*keys, "id").agg(F.min("cluster_id").alias("cluster_id"))
        )
        least, least_path = write_table(least, "labels")
        jump = least.select(*keys, F.col("id").alias("cluster_id"), F.col("cluster_id").alias("further"))
        jumped = least.join(jump, [*keys, "cluster_id"]).select(*keys, "id", F.col("further").alias("cluster_id"))
        before = labels.withColumnRenamed("cluster_id", "old")
        jumped, path = write_table(
            jumped.join(before, [*keys, "id"]).withColumn("moved", F.col("old") != F.col("cluster_id")), "labels"
        )
        drop_table(spark, least_path)
        if past:
            drop_table(spark, past)
        past = path
        labels = jumped.select(*keys, "id", "cluster_id")
        if jumped.filter("moved").isEmpty():
            return labels


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at the ends of edges, and the least id that each can reach."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        low = np.minimum(label[a], label[b])
        # What a label stands for is lowered as well, so that whole groups move.
        for end in (a, b):
            np.minimum.at(label, label[end], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return ids, ids[label]


def _labelled_in_task(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    types = "".join(f"`{key}` {nodes.schema[key].dataType.simpleString()}, " for key in keys)

    def label(table: pa.Table) -> pa.Table:
        ids, least = least_reached(table["a"].to_numpy(), table["b"].to_numpy())
        columns = {key: table[key].take(pa.array(np.zeros(len(ids), np.int64))) for key in keys}
        return pa.table({**columns, "id": pa.array(ids), "_least": pa.array(least)})

    # Without a key there is one block.
    found = edges.withColumn("_block", F.lit(0)).groupBy(*keys, "_block").applyInArrow(label, f"{types}id bigint, _least bigint")
    known = nodes.select(*keys, "id").dropna().join(found, [*keys, "id"], "left")
    return materialize(known.select(*keys, "id", F.coalesce("_least", "id").alias("cluster_id")), "labels")
