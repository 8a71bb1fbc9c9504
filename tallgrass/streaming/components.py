"""Connected components: tasks join their own links, labels spread between what they made; lineage is cut to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Links, and bytes of their ends, that a task joins at once at most; rows of an Arrow batch that it returns.
CHUNK, CHUNK_BYTES, BATCH = 1 << 22, 1 << 28, 1 << 16


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes; u and v are the ends of the links."""
    label = np.arange(n)
    while len(u):
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def local_roots(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of each chunk of links with the least node that they reach within it.

    Links come with those of the same first end, so that a chunk holds whole stars, which meet: a chunk of links from
    anywhere would fall into about as many parts as it has links, once there are many more nodes than a chunk has links.
    The tasks of an end of very many links are split (rebalance).
    """

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = pa.concat_arrays([b.column(k) for k in (0, 1) for b in held]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
        label, names = least_labels(u, v, len(order)), ends.dictionary.take(order)
        for at in range(0, len(names), BATCH):
            yield pa.RecordBatch.from_arrays([names.slice(at, BATCH), names.take(pa.array(label[at : at + BATCH]))], names=["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= CHUNK or size >= CHUNK_BYTES:
                yield from joined(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from joined(held)

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").where("a <> b").hint("rebalance", "a").sortWithinPartitions("a").mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component. edges: a, b, of one type.

    Each task joins its own links (local_roots), so that a row for each node and chunk is left. A node of several chunks links their
    roots; labels spread over these links only.
    """
    w = Window.partitionBy("node").orderBy("root")
    placed = cut(local_roots(edges).select("node", "root", F.first("root").over(w).alias("least"), F.row_number().over(w).alias("k")))
    one = placed.where("k = 1").select("node", "least")
    met = spread(placed.where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")))
    return one.join(met.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("root", "least").alias("root"))


def spread(links: DataFrame) -> DataFrame:
    """components() by labels: every round takes the least label of the neighbours, then the label of the label, until nothing changes."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label.node == near.a).select("node", F.least("root", "m").alias("r"), "root")
        jump = step.alias("s").join(label.select(F.col("node").alias("n2"), F.col("root").alias("r2")), F.col("s.r") == F.col("n2"), "left")
        new = cut(jump.select("node", F.least("r", F.coalesce("r2", "r")).alias("root"), F.col("s.root").alias("old")))
        if not new.where("root <> old").limit(1).count():
            return new.select("node", "root")
        label = new.select("node", "root")


def joined_members(nodes: DataFrame) -> DataFrame:
    """(root, members, size): the nodes of every root in order, joined by commas. nodes: node, root, a row per node.

    Nodes are dealt by range and joined where they lie; what meets in one task for a root is a text for each batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            root = b.column(0)
            new = np.flatnonzero(pc.not_equal(root.slice(1), root.slice(0, len(root) - 1)).to_numpy(zero_copy_only=False)) + 1
            cuts = np.concatenate([[0], new, [len(root)]])
            texts = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), b.column(2))
            at = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([root.take(at), b.column(1).take(at), pa.array(np.diff(cuts)), pc.binary_join(texts, ",")], names=["root", "first", "size", "text"])

    kind = nodes.schema["node"].dataType.simpleString()
    dealt = nodes.repartitionByRange("root", "node").sortWithinPartitions("root", "node").select("root", "node", F.col("node").cast("string").alias("text"))
    parts = dealt.mapInArrow(run, f"root {kind}, first {kind}, size long, text string")
    by = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("parts"), F.sum("size").alias("size"))
    return by.select("root", F.array_join("parts.text", ",").alias("members"), "size")


def named_sets(root: DataFrame) -> DataFrame:
    return joined_members(root).select("root", F.concat(F.lit("set:"), F.substring(F.sha2("members", 256), 1, 24)).alias("set_id"), "size", "members")


def correlated_sets(pairs: DataFrame) -> DataFrame:
    """Sets of gates that are linked by pairs (gate_a, gate_b): set id, size, members."""
    return named_sets(components(pairs.select(F.col("gate_a").alias("a"), F.col("gate_b").alias("b")))).drop("root")


def set_edges(pairs: DataFrame) -> DataFrame:
    """The pairs that link each correlated set: set_id, gate_a, gate_b, once each, the lesser gate first."""
    root = components(pairs.select(F.col("gate_a").alias("a"), F.col("gate_b").alias("b")))
    named = root.join(named_sets(root).select("root", "set_id"), "root").select("node", "set_id")
    edges = pairs.where("gate_a <> gate_b").select(F.least("gate_a", "gate_b").alias("gate_a"), F.greatest("gate_a", "gate_b").alias("gate_b")).distinct()
    return edges.join(named, edges.gate_a == named.node).select("set_id", "gate_a", "gate_b")
