"""Near copies by SimHash candidates and exact similarity (the pipeline's use of operator 3).

One fingerprint within 3 of 64 bits finds few of the texts that share only 0.8 of their shingles. So:

1. A text has n_prints fingerprints of 64 bits over its distinct three-word shingles, cut into keys of
   16 bits, and a sketch of 128 bits over its distinct five-word shingles.
2. Texts that share a key meet in a trie over the sketch's first half, which is joined with itself;
   the error budget is a loose one. This proposes links.
3. Texts that proposals connect are compared by the exact Jaccard of their sets of five-word shingles.
   Links of `least` or more stand; components of these are the groups.

Both the tries and the exact comparison run in cells of bounded size, see connect(): a group larger
than that costs a row for each of its members, not one for each pair of them, unless it truly falls
into parts that no link connects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.bitmap import Bitmap
from lamina.llm.common import materialised, slices, unused
from lamina.llm.components import components, join
from lamina.llm.simhash import first_row, keepers, trie_links, whole_groups, word_parts

#: Links (row, row) among the rows of a table, given the number of each row's group.
Linker = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]
KEY_BITS = 16
MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word, in order."""
    import xxhash

    return np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_parts(text))])


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each distinct run of n words (of all of them, if they are fewer), in ascending order."""
    n = min(n, len(words))
    total = np.full(len(words) - n + 1 if n else 0, n, np.uint64)
    for k in range(n):
        total = (total ^ total >> np.uint64(29)) * MIX + words[k : k + len(total)]
    return np.unique(mixed(total))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(32)


def fingerprints_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """n fingerprints of 64 bits of a set of hashes, as if of n hash functions: each mixes them another
    way. Bit b is 1 if more than half of the set have it."""
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(64 * n, np.int64)
    for a in range(0, len(hashes), 255):  # so many that a byte counts them
        bits = np.unpackbits(mixed(hashes[a : a + 255, None] ^ seeds).view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)


def signatures(df: DataFrame, n_prints: int, id_column: str = "doc_id", text_column: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, text_hash, fp, prints, bits_1, bits_2, size): fp is a hash of the set of five-word shingles,
    size their number, prints the fingerprints over three words and bits_1 and bits_2 the sketch."""
    import xxhash

    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                prints, sketch, fps, sizes = [], [], [], []
                for text in batch.column(2):
                    words = word_hashes(text.as_py() or "")
                    five = shingle_set(words, 5)
                    prints.append(fingerprints_of(shingle_set(words, 3), n_prints))
                    sketch.append(fingerprints_of(five, 2))
                    fps.append(xxhash.xxh3_64_intdigest(five.tobytes()))
                    sizes.append(len(five))
                longs = lambda x: pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
                one, two = np.stack(sketch).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * n_prints), longs(np.concatenate(prints)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), longs(fps), lists, longs(one), longs(two), pa.array(sizes, pa.int64())], ["id", "text_hash", "fp", "prints", "bits_1", "bits_2", "size"])

    rows = df.select(id_column, F.xxhash64(text_column).alias("text_hash"), text_column)
    return rows.mapInArrow(run, f"id {kind}, text_hash long, fp long, prints array<bigint>, bits_1 long, bits_2 long, size long")


def distinct_texts(marked: DataFrame) -> DataFrame:
    """signatures(), one row for each set of shingles, with the first of its rows."""
    rest = [c for c in marked.columns if c not in ("id", "text_hash", "fp")]
    return materialised(marked.groupBy("fp").agg(F.min(first_row("id")).alias("first"), *(F.first(c).alias(c) for c in rest)))


def connect(rows: DataFrame, linker: Linker, weight: Column, most: int, buffer_rows: int, suspects: DataFrame | None = None, most_broadcast: int = 100_000) -> DataFrame:
    """(node, other): enough links to connect all rows of a part that linker links. rows: (part, node, ...).
    suspects: (part) of all parts that may weigh more than `most`, if that is known.

    A part that weighs more than `most` is dealt to cells, and its row of smallest node goes to each of
    them: so what is dense becomes one component though no cell saw all of it. What then is outside a
    part's largest component (and only that) meets all rows of the part, in cells of pairs of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ("part", "cell"), buffer_rows):
            a, b = linker(table, group)
            node = table["node"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["node", "other"])

    def linked(cells: DataFrame) -> DataFrame:
        return cells.repartition("part", "cell").sortWithinPartitions("part", "cell").mapInArrow(run, "node long, other long")

    def few(found: DataFrame) -> DataFrame:
        return F.broadcast(found) if found.count() <= most_broadcast else found

    def dealt(n: str, seed: int = 0) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    cells_of = lambda w: F.ceil(F.sum(w) / most).cast("long")
    if suspects is not None and not suspects.head(1):
        return linked(rows.withColumn("cell", F.lit(0).cast("long")))
    asked = rows if suspects is None else rows.join(few(suspects), "part", "left_semi")
    sized = asked.groupBy(F.col("part").alias("of_part")).agg(cells_of(weight).alias("n_cells"), F.min("node").alias("leader"))
    large = materialised(sized.where("n_cells > 1"))
    if not large.head(1):
        return linked(rows.withColumn("cell", F.lit(0).cast("long")))
    known = rows.join(few(large), F.col("part") == F.col("of_part"), "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(1)))
    cells = known.select(*rows.columns, dealt("n_cells").alias("cell"))
    leaders = known.where("node = leader").select(*rows.columns, each("n_cells").alias("cell"))
    first = materialised(linked(cells.unionAll(leaders)))

    roots = components(first).select(F.col("node").alias("of_node"), "root")
    inside = rows.join(few(large.drop("leader")), F.col("part") == F.col("of_part")).drop("of_part")
    labelled = materialised(inside.join(roots, F.col("node") == F.col("of_node"), "left").withColumn("label", F.coalesce("root", "node")).drop("of_node", "root"))
    weights = labelled.groupBy("part", "label").agg(F.sum(weight).alias("w"))
    main = weights.groupBy(F.col("part").alias("of_part")).agg(F.max_by("label", F.struct("w", "label")).alias("main"))
    outside = F.col("label") != F.col("main")
    marked = labelled.join(few(materialised(main)), F.col("part") == F.col("of_part")).drop("of_part")
    blocks = materialised(marked.where(outside).groupBy(F.col("part").alias("of_part")).agg(cells_of(weight).alias("n_blocks")))
    if not blocks.head(1):
        return first
    # A cell is a block of those outside and a block of all; labels keep what is connected from being compared.
    met = marked.join(few(blocks), F.col("part") == F.col("of_part"))
    kept, cell = [*rows.columns, "label"], (F.col("block") * F.col("n_cells") + F.col("at")).alias("cell")
    them = met.where(outside).withColumns({"block": dealt("n_blocks", 1), "at": each("n_cells")}).select(*kept, cell)
    every = met.withColumns({"at": dealt("n_cells"), "block": each("n_blocks")}).select(*kept, cell)
    return first.unionAll(linked(them.unionAll(every)))


def labels_in(table: pa.Table) -> np.ndarray | None:
    return table["label"].to_numpy() if "label" in table.column_names else None


def crowded_keys(distinct: DataFrame, n_keys: int, most: int) -> DataFrame:
    """(part): all keys that more than `most` texts have, and few others. One that so many have is in
    more than its share of them in some partition; a partition counts all keys in an array."""
    share = max(1, most // max(1, distinct.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_keys << KEY_BITS, np.int32)
        for batch in batches:
            prints = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            keys = np.ascontiguousarray(prints).view(f"u{KEY_BITS // 8}").astype(np.int32) + (np.arange(n_keys, dtype=np.int32) << KEY_BITS)
            counts += np.bincount(keys.ravel(), minlength=len(counts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > share).astype(np.int64))], ["part"])

    return materialised(distinct.select("prints").mapInArrow(run, "part long").distinct())


def proposals(distinct: DataFrame, n_prints: int, budget: int, sketch_bits: int, most: int = 1 << 14, buffer_rows: int = 1 << 16) -> DataFrame:
    """(node, other): links that connect all distinct_texts() of which a key is equal, the first half
    of the sketch differs in at most budget bits and the whole in at most sketch_bits."""
    per = 64 // KEY_BITS
    number = F.explode(F.sequence(F.lit(0), F.lit(n_prints * per - 1))).alias("k")
    keyed = distinct.select("fp", "bits_1", "bits_2", "prints", number)
    key = F.expr(f"(k * {1 << KEY_BITS}L) + (shiftrightunsigned(element_at(prints, int(k div {per}) + 1), {KEY_BITS} * (k % {per})) & {(1 << KEY_BITS) - 1})")
    rows = keyed.select(key.alias("part"), F.col("fp").alias("node"), "bits_1", "bits_2")

    def linker(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = (table[c].to_numpy().view(np.uint64) for c in ("bits_1", "bits_2"))
        order = np.lexsort((one, group))
        one, two, labels = one[order], two[order], labels_in(table)
        alike = lambda a, b: np.bitwise_count(one[a] ^ one[b]).astype(np.int16) + np.bitwise_count(two[a] ^ two[b]) <= sketch_bits
        a, b = trie_links(group[order], one, budget, alike, None if labels is None else labels[order])
        return order[a], order[b]

    return connect(rows, linker, F.lit(1), most, buffer_rows, crowded_keys(distinct, n_prints * per, most))


def jaccard_links(sets: list[np.ndarray], sketch: np.ndarray, sketch_bits: int, least: float, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, smaller index) that connect all pairs of these sets that have a Jaccard of `least`
    or more and whose sketches (rows of two words) differ in at most sketch_bits; equal labels are
    connected from the start."""
    n = len(sets)
    root = np.arange(n)
    if labels is not None:
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        join(root, np.arange(n), first[of])
    before = root.copy()
    sizes = np.array([len(x) for x in sets])
    for i in range(n - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(rest) or not sizes[i]:
            continue
        # two sets can't be alike if one is much larger
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i])]
        rest = rest[np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int16) <= sketch_bits]
        near = []
        for j in rest.tolist():
            place = np.searchsorted(sets[i], sets[j])
            common = int((sets[i][np.minimum(place, sizes[i] - 1)] == sets[j]).sum())
            if common >= least * (sizes[i] + sizes[j] - common):
                near.append(j)
        join(root, np.full(len(near), i), np.array(near, int))
    linked = np.flatnonzero(root != before)
    return linked, root[linked]


def texts_of(df: DataFrame, members: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(*members, text) of members (id, text_hash, ...); other rows are left out before the shuffle."""
    rows = df.select(F.col(id_column).alias("row_id"), F.xxhash64(text_column).alias("row_hash"), F.col(text_column).alias("text"))
    maybe = Bitmap(members.select(F.xxhash64("id", "text_hash").alias("of")), "of")
    rows = maybe.filter(rows.withColumn("of", F.xxhash64("row_id", "row_hash")), "of").drop("of").dropDuplicates(["row_id", "row_hash"])
    return rows.join(members, rows["row_id"].eqNullSafe(members["id"]) & (rows["row_hash"] == members["text_hash"])).drop("row_id", "row_hash")


def verified(df: DataFrame, distinct: DataFrame, proposed: DataFrame, least: float, sketch_bits: int, id_column: str, text_column: str, most_shingles: int = 1 << 17, buffer_rows: int = 1 << 10) -> DataFrame:
    """(node, other): links that connect all texts that proposals connect, whose sketches are within
    sketch_bits, and whose sets of five-word shingles have a Jaccard of `least` or more."""
    roots = materialised(components(proposed))
    labels = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    columns = ["node", F.col("root").alias("part"), F.greatest("size", F.lit(256)).alias("weight"), "bits_1", "bits_2", "first.id", "first.text_hash"]
    members = materialised(labels.join(distinct, labels["node"] == distinct["fp"]).select(*columns))
    rows = materialised(texts_of(df, members, id_column, text_column).select("part", "node", "weight", "bits_1", "bits_2", "text"))

    def linker(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sketch = np.stack([table[c].to_numpy().view(np.uint64) for c in ("bits_1", "bits_2")], axis=1)
        texts, labels, found = table["text"], labels_in(table), []
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop - start > 1:
                sets = [shingle_set(word_hashes(texts[k].as_py() or ""), 5) for k in range(start, stop)]
                a, b = jaccard_links(sets, sketch[start:stop], sketch_bits, least, None if labels is None else labels[start:stop])
                found.append((start + a, start + b))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    return connect(rows, linker, F.col("weight"), most_shingles, buffer_rows)


def keep_first(df: DataFrame, least: float = 0.8, n_prints: int = 10, budget: int = 22, sketch_bits: int = 34, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of df, one of each group of near copies: that of the smallest id (ids that are null come
    last, equal ones go by their shingles and texts). Columns stay, whatever their names.

    Near copies are texts whose sets of five-word shingles have a Jaccard of `least` or more; a group
    is what links of this kind connect. Texts of one set of shingles (null, empty and blank ones
    have the empty set; white space and the case of A-Z do not count) and rows that repeat are one. An
    empty table gives an empty result.

    SimHash proposes the pairs. A bit differs with probability acos(2s / (1 + s)) / pi at similarity s,
    0.15 at 0.8: so one of 40 keys of 16 bits is equal with probability 0.95 where a passage of a fifth
    is new, and 0.99 where single words changed (which leave more of the three-word shingles); and
    the sketch is within 34 of 128 bits in all but a thousandth. Above 0.8 all of it rises fast.
    """
    marked = materialised(signatures(df, n_prints, id_column, text_column))
    distinct = distinct_texts(marked)
    proposed = materialised(proposals(distinct, n_prints, budget, sketch_bits))
    found = materialised(verified(df, distinct, proposed, least, sketch_bits, id_column, text_column))
    hash_name, id_name, of_name = unused(df, "text_hash", "kept_id", "kept_hash")
    kept = keepers(distinct.select("fp", "first"), found).select(F.col("keeper.id").alias(id_name), F.col("keeper.text_hash").alias(of_name)).distinct()
    hashed = df.withColumn(hash_name, F.xxhash64(text_column))
    left = hashed.join(kept, hashed[id_column].eqNullSafe(kept[id_name]) & (hashed[hash_name] == kept[of_name]), "left_semi")
    return left.dropDuplicates([id_column, hash_name]).drop(hash_name)
