"""Byte-level BPE encoding and decoding with the tokenizers library (operator 6).

A file of ranks becomes a `tokenizers` model: every byte is written as a printable character, and
every way to split a token into two others is a merge. The library takes the merge of the lowest place
in that list, where a pure rank file takes the lowest rank and then the leftmost; so of the splits of
one token those come first that are the left one of two that overlap. A piece that is a token is one.
The tests hold the ids against tiktoken's.

Decoding maps ids to characters and reverses the byte table; a character that is split over tokens is
put together again, and belongs to the token that ends it.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import functools
import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import slices
from lamina.llm.pieces import PieceMemo, piece_encoder, segments
from lamina.llm.token_counts import byte_characters


def split_order(token: bytes, at: int) -> tuple[bool, int]:
    """Orders the splits of a token. Two merges to the same token overlap, as x|y|z with xy = yz, only
    if len(x) is a period of it: then the split after x must come before the one after y."""
    return token[at:] != token[: len(token) - at], at


class ByteBpe:
    def __init__(self, rank_path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        to_char = byte_characters()
        name = lambda raw: "".join(map(to_char.__getitem__, raw))
        merges = [(ranks[t], split_order(t, k), name(t[:k]), name(t[k:])) for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.tokenizer = Tokenizer(models.BPE({name(t): r for t, r in ranks.items()}, [m[2:] for m in sorted(merges)], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in to_char.items()}
        self.bytes_of = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.tokenizer.get_vocab().items()}
        self.text_of: dict[int, str] = {}  # tokens of whole characters
        for i, raw in self.bytes_of.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.text_of[i] = raw.decode()
        self.encode = piece_encoder(self.tokenizer)
        self.memo = PieceMemo(self._piece)

    def _piece(self, piece: str) -> tuple[tuple[int, ...], str, bytes, int]:
        """(ids, the same as text, what they decode to, tokens that hold only part of a character)."""
        ids = tuple(self.encode(piece))
        named = ",".join(map(str, ids))
        if all(map(self.text_of.__contains__, ids)):
            return ids, named, "".join(map(self.text_of.__getitem__, ids)).encode(), 0
        spans = self.offsets(piece, ids)
        partial = sum(any(a < stop and start < b for a, b in spans[max(0, k - 1) : k] + spans[k + 1 : k + 2]) for k, (start, stop) in enumerate(spans))
        return ids, named, "".join(self.decode(ids)).encode(), partial

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self.memo.of(text)))

    def digests(self, text: str) -> tuple[int, str, str, int]:
        """(tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of what the ids decode to,
        tokens that hold only part of a character)."""
        n, partial, encoded, decoded = 0, 0, hashlib.sha256(), hashlib.sha256()
        for part in segments(text):
            found = self.memo.of(part)
            if found:
                encoded.update((("," if n else "") + ",".join([x[1] for x in found])).encode())
                decoded.update(b"".join([x[2] for x in found]))
                n += sum([len(x[0]) for x in found])
                partial += sum([x[3] for x in found])
        return n, encoded.hexdigest(), decoded.hexdigest(), partial

    def decode(self, ids: Sequence[int]) -> list[str]:
        """The text of each token; a character split over tokens belongs to the token that ends it,
        and bytes that are no UTF-8 become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes_of[i], final=k == len(ids) - 1) for k, i in enumerate(ids)]

    def offsets(self, text: str, ids: Sequence[int]) -> list[tuple[int, int]]:
        """Characters [start, stop) of each token; tokens that share a character both span it."""
        ends = list(accumulate(len(self.bytes_of[i]) for i in ids))
        starts = [0, *ends][: len(ends)]
        if text.isascii():
            return list(zip(starts, ends, strict=True))
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))
        return [(int(character[a]), int(character[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@functools.lru_cache(maxsize=2)
def byte_bpe(rank_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(rank_path, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, ids array<int>, starts array<int>, stops array<int>): the tokens of each text and the
    characters they span. A null or empty text has empty arrays; ids of rows may be null or repeat."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_path, pattern)
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = [bpe.ids(t) for t in texts]
                spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, ints), pa.array([[a for a, _ in s] for s in spans], ints), pa.array([[b for _, b in s] for s in spans], ints)], [id_column, "ids", "starts", "stops"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, ids array<int>, starts array<int>, stops array<int>")


def decode(df: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of rows of token ids; null or empty ids give an empty text."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(bpe.decode(i or [])) for i in batch.column(1).to_pylist()], pa.string())], [id_column, "text"])

    return df.select(id_column, ids_column).mapInArrow(run, f"{id_column} {kind}, text string")


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, n_partial): digests of the encoding and of what it
    decodes to, and how many tokens hold only part of a character; one row for each row in. A null or empty text has no tokens (digests of the empty string); ids may
    be null or repeat; an empty table gives an empty result; other columns are not looked at."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(rank_path, pattern)
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                n, encoded, decoded, partial = zip(*(bpe.digests(text.as_py() or "") for text in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded), pa.array(partial, pa.int64())], [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "n_partial"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_partial long")
