"""Packing of documents into sequences (operator 8): first-fit decreasing with a tournament tree of
bin capacities, run independently in randomised groups.

Texts become ids where they are read, and only lengths and checksums of pieces are kept and shuffled:
to as many groups as their number asks for, by a hash, so that each group is a random draw. A group
has about `group_pieces` pieces whatever the number of documents or of partitions, and none needs another.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialised, slices, unused
from lamina.llm.pieces import PieceMemo, piece_encoder, segments
from lamina.llm.simhash import whole_groups


GROUP_BITS = 32


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids:
    """Whole texts to little-endian 32-bit ids, as the tokenizers library gives them."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        encode = piece_encoder(self.tokenizer)
        self.memo = PieceMemo(lambda piece: pack_ids(encode(piece)))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # rare: no piece may hold part of a special token
            return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(b"".join(self.memo.of(part)) for part in segments(text))


@functools.lru_cache(maxsize=2)
def ids_of(tokenizer_path: str) -> Ids:
    return Ids(tokenizer_path)


class TournamentTree:
    """The largest room below each node; finds the first bin with enough room in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Takes room for length in the first bin that has it: (bin, room before)."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        before, chosen = room[node], node - self.leaves
        room[node] = before - length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return chosen, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length; ties keep their order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    if len(lengths):
        tree = TournamentTree(len(lengths), capacity)
        for k in np.argsort(-lengths, kind="stable").tolist():
            bins[k], before = tree.place(int(lengths[k]))
            offsets[k] = capacity - before
    return bins, offsets


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_column: str, text_column: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document cut after every `capacity` ids."""
    kind = df.schema[id_column].dataType.simpleString()
    end = pack_ids([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                rows = []
                for row, text in enumerate(batch.column(1)):
                    raw = ids.of(text.as_py() or "") + end
                    rows += [(row, a // 4, (len(cut := raw[a : a + 4 * capacity])) // 4, zlib.crc32(cut), len(raw) // 4) for a in range(0, len(raw), 4 * capacity)]
                row, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)], [id_column, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group_pieces: int = 32_768, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and then end_id, so a null or empty text is one id. Ids of rows may be null
    or repeat (each row is packed for itself); an empty table gives an empty result; columns other
    than the two named are not looked at. sequence_id is unique: the number of the group above
    GROUP_BITS bits of a number within it.
    """
    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens"]

    found = pieces(df, tokenizer_path, capacity, end_id, id_column, text_column)
    group_number, row_number, draw = unused(found, "group_number", "row_number", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, (group_number,), group_pieces):
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows = table.slice(a, b - a)
                bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
                first = rows[group_number][0].as_py() << GROUP_BITS
                yield pa.RecordBatch.from_arrays([*(rows[n].combine_chunks() for n in names), pa.array(bins + first), pa.array(offsets)], [*names, "sequence_id", "offset"])

    cut = materialised(found.withColumn(row_number, F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group_pieces))
    # The row's number keeps rows that repeat from all being drawn to one group.
    drawn = cut.select(*names, F.pmod(F.xxhash64(*names, row_number), F.lit(groups)).alias(group_number), F.xxhash64(row_number, *names).alias(draw))
    shuffled = drawn.repartition(group_number).sortWithinPartitions(group_number, draw).select(group_number, *names)
    return shuffled.mapInArrow(run, f"{id_column} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
