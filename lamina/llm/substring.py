"""Substring deduplication by sliding spans of sentences (operator 9).

Every run of several consecutive sentences that has a dozen words in all is a span. Spans are hashed,
joined globally by hash, and the sentences that a repeated span covers go, except at the span's first
place in the corpus. The least number of words keeps runs such as "No. Yes." from counting as repeats,
which very short sentences form by chance; there is no other exception.

Not all spans need a hash of their own: a span holds the shortest spans that begin, or end, at each of
its sentences, these return wherever it returns, and together they cover it. So only these are hashed.

Texts are read once for that, and the hashes are kept as a table. Hashes alone are counted, with partial
sums before the shuffle; then only those that return are shuffled with their places. A hash that a
third of all rows share is a few partial counts, and later one skewed side of a join, which the
engine splits. Texts in which nothing is repeated are not shuffled at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.bitmap import Bitmap
from lamina.llm.common import discard, materialised, numbered_columns, slices, stored

BOUNDARY = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?:\s+|\Z|(?<=[。！？]))|\s*\n\s*")
LENGTH_BITS = 24


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, stop) of each sentence; they cover the text, with the white space that follows them."""
    out, start = [], 0
    for m in BOUNDARY.finditer(text):
        stop = m.end()
        if text[start:stop].strip():
            out.append((start, stop))
            start = stop
    if start < len(text):
        if text[start:].strip() or not out:
            out.append((start, len(text)))
        else:
            out[-1] = (out[-1][0], len(text))
    return out


def runs(counts: list[int], least_sentences: int, least_words: int) -> set[tuple[int, int]]:
    """[first, end) of the shortest spans from each sentence on and up to each sentence, of sentences
    with so many words."""
    n, found = len(counts), set()
    end, words = 0, 0
    for first in range(n):  # shortest span that begins here
        while end < n and (end - first < least_sentences or words < least_words):
            words += counts[end]
            end += 1
        if end - first >= least_sentences and words >= least_words:
            found.add((first, end))
        words -= counts[first]
    first, words = n, 0
    for end in range(n, 0, -1):  # shortest span that ends here
        while first > 0 and (end - first < least_sentences or words < least_words):
            first -= 1
            words += counts[first]
        if end - first >= least_sentences and words >= least_words:
            found.add((first, end))
        words -= counts[end - 1]
    return found


def hashed_runs(text: str, least_sentences: int, least_words: int) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first sentence, end) of each of these spans; case and white space do not count."""
    import xxhash

    counts, digests = [], []
    for a, b in sentences(text):
        words = text[a:b].lower().split()
        counts.append(len(words))
        digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
    for first, end in runs(counts, least_sentences, least_words):
        yield xxhash.xxh3_128_digest(b"".join(digests[first:end])), first, end


class SubstringDedup:
    def __init__(self, least_sentences: int = 2, least_words: int = 12, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 2 << 20):
        self.rule = least_sentences, least_words
        self.id_column, self.text_column, self.slice_bytes = id_column, text_column, slice_bytes

    def spans(self, df: DataFrame) -> DataFrame:
        """(doc, text_hash, high, low, place), one row for each text with spans: halves of their hashes,
        and their places, which hold the first sentence above LENGTH_BITS bits of the number of sentences."""
        rule, size = self.rule, self.slice_bytes
        kind = df.schema[self.id_column].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", size):
                    found, ends, places = [], [0], []
                    for text in batch.column(2):
                        for digest, first, end in hashed_runs(text.as_py() or "", *rule):
                            found.append(digest)
                            places.append(first << LENGTH_BITS | end - first)
                        ends.append(len(places))
                    halves = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
                    bounds = pa.array(ends, pa.int32())
                    lists = (pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]), np.array(places, np.int64)))
                    out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc", "text_hash", "high", "low", "place"])
                    yield out.filter(pa.array(np.diff(ends) > 0))

        rows = df.select(F.col(self.id_column).alias("doc"), F.xxhash64(self.text_column).alias("text_hash"), F.col(self.text_column).alias("text"))
        return rows.mapInArrow(run, f"doc {kind}, text_hash long, high array<bigint>, low array<bigint>, place array<bigint>")

    def repeats(self, df: DataFrame) -> DataFrame:
        """(doc, text_hash, places): the spans of each document whose first place is elsewhere. The
        first place is the one of the smallest id (null last), then hash of the text, then position."""
        spans, folder = stored(self.spans(df), "spans")
        counted = spans.select(F.explode("high").alias("again")).groupBy("again").count()
        returning = materialised(counted.where("count > 1").select("again"))
        again = Bitmap(returning, "again")
        kind = df.schema[self.id_column].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                high, low, place = (batch.column(k).flatten() for k in (2, 3, 4))
                kept = np.flatnonzero(again.holds(high.to_numpy()))
                row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))[kept]
                yield pa.RecordBatch.from_arrays([high.take(kept), low.take(kept), batch.column(0).take(row), batch.column(1).take(row), place.take(kept)], ["high", "low", "doc", "text_hash", "place"])

        maybe = spans.mapInArrow(run, f"high long, low long, doc {kind}, text_hash long, place long")
        kept = materialised(maybe.join(returning, maybe["high"] == returning["again"], "left_semi"))
        discard(df.sparkSession, folder)
        where = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_hash", "place")
        # Kept apart from the join, or no partition of the join could be split.
        first = materialised(kept.groupBy(F.col("high").alias("of_high"), F.col("low").alias("of_low")).agg(F.min(where).alias("first")))
        met = kept.join(first, (kept["high"] == first["of_high"]) & (kept["low"] == first["of_low"])).where(where != F.col("first"))
        return materialised(met.select("doc", "text_hash", "place").groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places")))

    def dedup(self, df: DataFrame) -> DataFrame:
        """The rows of df with repeated sentences taken out of the text, and with n_sentences,
        n_removed and removed (array of [start, stop) characters of the old text).

        A null text stays null, an empty one empty: neither has sentences. A text of which all is
        repeated becomes empty; its row stays. Rows of one id and text are one document: what they
        share is no repeat, but what one of them holds twice is. Ids may be null; an empty table gives an
        empty result. Other columns stay as they are, but a column named as one of the three new ones
        is replaced.
        """
        added = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))]
        df = df.drop(*(f.name for f in added))
        names, at, n_columns, size = df.columns, df.columns.index(self.text_column), len(df.columns), self.slice_bytes
        repeats = self.repeats(df)
        touched = Bitmap(repeats.select(F.xxhash64("doc", "text_hash").alias("of")), "of")
        plain = numbered_columns(df)
        id_column, text_column = f"column_{names.index(self.id_column)}", f"column_{at}"
        hashed = plain.withColumn("own_hash", F.xxhash64(text_column)).withColumn("both", F.xxhash64(id_column, "own_hash"))
        maybe = touched.filter(hashed, "both")
        joined = maybe.join(repeats, maybe[id_column].eqNullSafe(repeats["doc"]) & (maybe["own_hash"] == repeats["text_hash"]), "left").select(*plain.columns, "places")
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def cleaned(batch: pa.RecordBatch, places: Iterable[list[int]]) -> pa.RecordBatch:
            texts, rows = [], []
            for text, own in zip(batch.column(at), places, strict=True):
                kept, *row = clean(text.as_py(), own)
                texts.append(kept)
                rows.append(row)
            n, gone, removed = zip(*rows, strict=True)
            columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(n_columns)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, spans_type)], [*batch.schema.names[:n_columns], "n_sentences", "n_removed", "removed"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text_column, size):
                    yield cleaned(batch, (x.as_py() or [] for x in batch.column(n_columns)))

        def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole.filter(pa.array(~touched.holds(whole.column(n_columns + 1).to_numpy()))), text_column, size):
                    yield cleaned(batch, repeat([], batch.num_rows))

        schema = T.StructType([*plain.schema.fields, *added])
        return joined.mapInArrow(run, schema).unionAll(hashed.mapInArrow(untouched, schema)).toDF(*names, *(f.name for f in added))


def clean(text: str | None, places: list[int]) -> tuple[str | None, int, int, list[dict[str, int]]]:
    """(text without the sentences of those places, sentences, sentences removed, spans removed)."""
    if not text:
        return text, 0, 0, []
    parts = sentences(text)
    gone = set()
    for place in places:
        first = place >> LENGTH_BITS
        gone.update(range(first, first + (place & (1 << LENGTH_BITS) - 1)))
    removed: list[dict[str, int]] = []
    for k in sorted(gone):
        start, stop = parts[k]
        if removed and removed[-1]["stop"] == start:
            removed[-1]["stop"] = stop
        else:
            removed.append({"start": start, "stop": stop})
    return "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in gone), len(parts), len(gone), removed
