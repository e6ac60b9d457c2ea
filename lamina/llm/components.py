"""Connected components of links that no machine could hold (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialised


def join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merges what is linked; root[i] ends as the smallest index linked to i."""
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def stars(links: DataFrame, most: int) -> DataFrame:
    """(child, parent): links that connect what links (node, other) connect, each from a node to the
    smallest one that it is connected with among about `most` links: of those, one a node at most.

    Links are dealt by node, so all that tie a node to the same few others are seen together. A task
    takes as many as make `most` on average, and holds no more than that and a batch at a time.
    """

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([c.to_numpy() for k in (0, 1) for c in (b.column(k) for b in held)]), return_inverse=True)
        root = np.arange(len(nodes))
        join(root, *np.split(at, 2))
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], ["child", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield star(held)
                held = []
        if held:
            yield star(held)

    dealt = materialised(links.where("node <> other").select("node", "other").repartition("node"))
    return dealt.coalesce(-(-dealt.count() // most) or 1).mapInArrow(run, "child long, parent long")


def components(links: DataFrame, most: int = 1 << 18) -> DataFrame:
    """links: (node, other) of longs, in any direction. Returns (node, root) of all nodes but the
    roots; the root is the smallest node of its component. No link or an empty table: empty.

    Tasks first replace the links they see by stars, see stars(): a row is then shuffled for each node
    and not for each of its links, of which near copies have one for each key they share.

    A round hangs every larger neighbour on the smallest one, then all smaller ones likewise. The
    number of links never grows; rounds grow with the logarithm of the longest path. Minima are
    combined before they are shuffled, and joins on a node with many links are left to the
    engine's splitting of skewed partitions.
    """
    edges = materialised(stars(links, most).distinct())
    state = None
    while True:
        print_of = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("child", "parent"))).first()
        if print_of == state or not print_of[0]:
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        state = print_of
        both = edges.select(F.col("child").alias("at"), F.col("parent").alias("near")).unionAll(edges.select(F.col("parent").alias("at"), F.col("child").alias("near")))
        # Kept apart from the join, or the partition of a node with many links could not be split.
        least = materialised(both.groupBy("at").agg(F.min("near").alias("least")).select("at", F.least("at", "least").alias("least")))
        large = edges.join(least, edges["parent"] == least["at"]).select("child", F.col("least").alias("parent")).distinct()
        first = large.groupBy(F.col("child").alias("at")).agg(F.min("parent").alias("least"))
        met = large.join(first, large["child"] == first["at"])
        small = met.select(F.explode(F.array(F.struct("child", F.col("least").alias("parent")), F.struct(F.col("parent").alias("child"), F.col("least").alias("parent")))).alias("e")).select("e.child", "e.parent")
        edges = materialised(small.where("child <> parent").distinct())
