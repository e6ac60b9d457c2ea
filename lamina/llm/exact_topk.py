"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 2).

A vector is a sparse row: its components are terms, its integers their weights. Queries and
candidates are cut into blocks; each pair of blocks is one task-sized cell. In a cell, one term after
the other scatters its weighted postings into a dense array of scores (queries by candidates), the k
best of each query are selected by partition, and the selections of all cells are merged. Every
query meets every candidate, so the work is what was asked for; memory is that of one cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST, LARGEST = (1 << 63) - 1, sys.float_info.max


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, weights array<double>): floor(scale * x) of rows with an id and a finite vector. What the
    product takes beyond a double is the largest double."""
    wide = F.transform(vector_column, lambda x: x.cast("double"))
    sound = F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    # Spark's floor of a double is a long and saturates; what lies beyond a long is whole already.
    floor = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    within = lambda y: F.greatest(F.least(y, F.lit(LARGEST)), F.lit(-LARGEST))
    return df.where(sound).select(F.col(id_column).cast("long").alias("id"), F.transform(wide, lambda x: floor(within(x * F.lit(float(scale))))).alias("weights"))


def dense(ids: pa.Array, weights: pa.Array, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix rows by terms); a row shorter than others has no weight in the further terms."""
    lengths = pc.list_value_length(weights).to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(ids), terms))
    matrix[np.repeat(np.arange(len(ids)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = weights.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(), matrix


def number_kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """The smallest kind of number in which every sum is exact; Python's integers if none is."""
    bound = np.abs(queries).max(axis=0, initial=0) @ np.abs(candidates).max(axis=0, initial=0)
    limits = ((np.float32, 1 << 24), (np.float64, 1 << 53), (np.int64, 1 << 62))
    return next((kind for kind, limit in limits if bound < limit), object)


def as_kind(matrix: np.ndarray, kind: type) -> np.ndarray:
    """The matrix of that kind, by terms."""
    flipped = np.ascontiguousarray(matrix.T)
    if kind is not object:
        return flipped.astype(kind)
    out = np.empty(flipped.shape, object)
    out.ravel()[:] = [int(x) for x in flipped.ravel()]
    return out


class Postings:
    """The candidates of a cell by term: which have it, and with what weight."""

    def __init__(self, candidates: np.ndarray, kind: type):
        self.kind, self.size = kind, len(candidates)
        weights = as_kind(candidates, kind)
        self.lists = []
        for row in weights:
            posted = np.flatnonzero(row)
            self.lists.append((None, row) if len(posted) == len(row) else (posted, row[posted]))

    def accumulate(self, queries: np.ndarray) -> np.ndarray:
        """Scores (queries by candidates): each term scatters its weighted postings into them."""
        scores = np.zeros((len(queries), self.size), self.kind)
        gain = np.empty_like(scores)
        for asked, (posted, weights) in zip(as_kind(queries, self.kind), self.lists, strict=True):
            if not len(weights) or not asked.any():
                continue
            if posted is None:
                np.multiply(asked[:, None], weights, out=gain)
                scores += gain
            else:
                scores[:, posted] += np.multiply.outer(asked, weights)
        return scores


def best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The k best candidates of each query, ties to the smaller id; never the query's own row.
    ids ascend. Returns (query's place, id, score)."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    for place, (own, row) in enumerate(zip(query_ids.tolist(), scores, strict=True)):
        low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        other = np.concatenate([np.arange(low), np.arange(high, len(ids))]) if high > low else None
        row, those = (row, ids) if other is None else (row[other], ids[other])
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above = np.flatnonzero(row > least)
            chosen = np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]])
        else:
            chosen = np.arange(len(row))
        out[0].extend([place] * len(chosen))
        out[1].extend(those[chosen].tolist())
        out[2].extend(max(-MOST - 1, min(MOST, int(x))) for x in row[chosen])
    return out


def top_k(df: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding", query_block: int = 4096, candidate_block: int = 8192, block_bytes: int = 16 << 20, most_scores: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of highest integer inner product.

    is_query is a SQL condition on `id`. Rows whose id is null, and vectors that are null or hold a
    null or non-finite component, take no part. A query's own row is each row with its id; as
    candidates, rows that repeat each count, and as queries they are one, but unequal vectors of one
    id are queries of their own. Ties go to the smaller id. Vectors of unequal length meet in the terms
    they share; an empty one scores 0. A score beyond a long is given as the nearest long. With fewer
    than k candidates, all are given; an empty table gives an empty result; other columns are not
    looked at. A cell holds about candidate_block + query_block rows (fewer where long vectors would make
    either more than block_bytes) of as many doubles as the longest vector.
    """
    rows = quantised(df, id_column, vector_column, scale)
    n_rows, n_queries, terms = rows.select(F.count("*"), F.count_if(F.expr(is_query)), F.max(F.size("weights"))).first()
    query_block, candidate_block = (max(1, min(n, block_bytes // (8 * max(1, terms or 0)))) for n in (query_block, candidate_block))
    query_blocks, blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // candidate_block))
    # Rows are dealt to blocks by their values and the part of the input they are read from, so that a
    # lost task deals them alike again, and rows that repeat don't all meet in one block.
    deal = lambda n, *more: F.pmod(F.xxhash64("id", "weights", *more), F.lit(n))
    candidates = rows.select(F.lit(False).alias("asks"), "id", "weights", deal(blocks, F.spark_partition_id()).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    queries = rows.where(is_query).distinct().select(F.lit(True).alias("asks"), "id", "weights", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(query_blocks, F.lit(1)).alias("query_block"))

    def cell(group: pa.Table) -> pa.Table:
        asks = group["asks"].combine_chunks()
        sides = group.filter(asks), group.filter(pc.invert(asks))
        terms = pc.max(pc.list_value_length(group["weights"])).as_py() or 0
        (query_ids, q), (ids, c) = (dense(s["id"].combine_chunks(), s["weights"].combine_chunks(), terms) for s in sides)
        keys, order = sides[0]["vector"].to_numpy(), np.argsort(ids, kind="stable")
        ids, postings = ids[order], Postings(c[order], number_kind(q, c))
        found: tuple[list[int], list[int], list[int]] = ([], [], [])
        strip = max(1, most_scores // max(1, len(c)))  # a strip's scores stay in the processor's cache
        for a in range(0, len(q), strip):
            place, those, scores = best(query_ids[a : a + strip], ids, postings.accumulate(q[a : a + strip]), k)
            found[0].extend(a + x for x in place)
            found[1].extend(those)
            found[2].extend(scores)
        place = np.array(found[0], np.int64)
        return pa.table({"query_id": query_ids[place], "vector": keys[place], "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    both = candidates.unionAll(queries).withColumn("vector", F.xxhash64("weights"))
    found = both.groupBy("block", "query_block").applyInArrow(cell, "query_id long, vector long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
