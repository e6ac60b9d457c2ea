"""SimHash near-duplicates by a self-join of binary tries (operator 3).

Fingerprints within the error budget of 3 bits agree in at least one of four blocks of 16 bits. So
each distinct fingerprint goes to four groups, one for each block and its value, and there the rest
of it is a path in a binary trie. The trie is joined with itself: pairs of nodes descend together,
add up the bits in which they differ, and are dropped when these exceed the budget. A group larger
than `most` is split by the same argument over its remaining bits, again and again until what is
left fits; so a value shared by a third of all rows is no burden to one task, and no link is lost.

A task emits links from each fingerprint to one representative of what it found linked, not all
pairs; the components of those links are the components of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialised, slices
from lamina.llm.components import components, join

BITS = 64

#: What rows share that meet in one trie.
GROUP = ("mask", "value")


#: What words are parted by, and after how many characters of a text a new part begins.
BLANK, PART = re.compile(r"[\x20\x09-\x0D]"), 1 << 20


def hashes_of(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of that many words, which are joined by spaces."""
    import xxhash

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[shingle_words - 1 :].tolist()
    starts = [0, *(ends[: len(words) - shingle_words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def word_parts(text: str, part: int = PART) -> Iterator[list[bytes]]:
    """The words, part by part: runs of other than ASCII white space, with A-Z in lower case."""
    start = 0
    while start < len(text):
        cut = BLANK.search(text, start + part) if len(text) - start > part else None
        stop = cut.start() if cut else len(text)
        yield text[start:stop].encode().lower().split()
        start = stop


def shingle_hashes(text: str, shingle_words: int, part: int = PART) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, part by part; of the whole, if it has fewer
    words; none without words."""
    words, yielded = [], False
    for more in word_parts(text, part):
        words += more
        if len(words) >= shingle_words:
            yield hashes_of(words, shingle_words)
            words, yielded = words[len(words) - shingle_words + 1 :], True
    if words and not yielded:
        yield hashes_of(words, len(words))


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = h.view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    # how often each of 8 bytes has each value, and the bits of the values
    often = np.bincount((octets + np.arange(8, dtype=np.uint16) * 256).ravel(), minlength=2048).reshape(8, 256)
    return (often @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)).ravel()


def majority(counts: np.ndarray, total: int) -> int:
    """Bit b is 1 if more than half of the hashes have it; 0 without hashes."""
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle_words: int = 3) -> int:
    counts, total = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, shingle_words):
        counts += ones(h)
        total += len(h)
    return majority(counts, total)


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3, slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, text_hash, fp) of every row; text_hash tells rows of one id apart."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column, slice_bytes):
                fps = [fingerprint(t.as_py() or "", shingle_words) for t in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], [id_column, "text_hash", "fp"])

    return df.select(id_column, F.xxhash64(text_column).alias("text_hash"), text_column).mapInArrow(run, f"{id_column} {kind}, text_hash long, fp long")


def parts(free: list[int], n: int) -> list[int]:
    """Masks of n blocks of the free bits."""
    return [sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(free, dtype=int), n)]


def signed(mask: int) -> int:
    """The long with these 64 bits."""
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def trie_links(groups: np.ndarray, fps: np.ndarray, budget: int, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, labels: np.ndarray | None = None, most_pairs: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, representative) within each group; groups and fps as sorted by (group, fp). alike
    says of rows within the budget which are linked; without it, all are. Rows of a group with equal
    labels count as linked from the start.

    A node is a range of the sorted fingerprints that share their leading bits; all groups' tries
    descend at once, as arrays of node pairs. A pair of small nodes is compared leaf by leaf. Pairs of
    nodes whose rows are all connected already are dropped, so a dense group costs few comparisons;
    and neither node pairs nor compared rows are ever held in larger numbers than about most_pairs.
    """
    n = len(fps)
    root = np.arange(n, dtype=np.int32)
    if labels is not None:
        _, first, of = np.unique(np.stack([groups, labels]), axis=1, return_index=True, return_inverse=True)
        join(root, root.copy(), first.astype(np.int32)[of.ravel()])
    before, change = root.copy(), changes_in(root)

    def open_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        whole = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0])
        return ~(whole & (root[a0] == root[b0]))

    def compare(ranges: Sequence[np.ndarray]) -> None:
        nonlocal change
        ends = np.cumsum((ranges[1] - ranges[0]).astype(np.int64) * (ranges[3] - ranges[2]))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most_pairs, side="right")))
            own = [x[start:stop] for x in ranges]
            left = open_pairs(*own)
            start = stop
            if not left.any():
                continue
            a, b = products(*(x[left] for x in own))
            near = np.bitwise_count(fps[a] ^ fps[b]) <= budget
            near &= root[a] != root[b]
            a, b = a[near], b[near]
            if alike is not None and len(a):
                good = alike(a, b)
                a, b = a[good], b[good]
            if len(a):
                join(root, a, b)
                change = changes_in(root)

    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])).astype(np.int32)
    low, high = edge, np.append(edge[1:], np.int32(n))
    wide = high - low > 1
    low, high = low[wide], high[wide]
    work = [(BITS - 1, low, high, low, high, np.zeros(len(low), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while work:
        bit, *columns = work.pop()
        left = open_pairs(*columns[:4])
        a0, a1, b0, b1, errors = (x[left] for x in columns)
        if len(a0) > most_pairs:  # depth first over slices: the frontier stays small
            half = len(a0) // 2
            work += [(bit, *(x[half:] for x in (a0, a1, b0, b1, errors))), (bit, *(x[:half] for x in (a0, a1, b0, b1, errors)))]
            continue
        sizes = (a1 - a0).astype(np.int64) * (b1 - b0)
        few = sizes <= (32 if bit >= 0 else most_pairs)
        compare([x[few] for x in (a0, a1, b0, b1)])
        if few.all():
            continue
        a0, a1, b0, b1, errors = (x[~few] for x in (a0, a1, b0, b1, errors))
        if bit < 0:  # leaves of many equal fingerprints, in parts
            for pair in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):
                work += [(bit, *(np.array([x], np.int32) for x in part), np.zeros(1, np.int8)) for part in reversed(halves(*pair))]
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1))]).astype(np.int32)
        count = ones[bit]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0  # a node with itself: one of its two mixed pairs is enough
        pairs = [(a0, am, b0, bm, errors, None), (am, a1, bm, b1, errors, None), (a0, am, bm, b1, errors + 1, None), (am, a1, b0, bm, errors + 1, ~same)]
        kept = []
        for x0, x1, y0, y1, e, also in pairs:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            ok &= (x0 != y0) | (x1 - x0 > 1)
            if also is not None:
                ok &= also
            kept.append([x[ok] for x in (x0, x1, y0, y1, e)])
        work.append((bit - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    linked = np.flatnonzero(root != before)
    return linked, root[linked]


def changes_in(root: np.ndarray) -> np.ndarray:
    """How often the value has changed up to each place: equal at both ends of a range of one value."""
    return np.concatenate([[0], np.cumsum(root[1:] != root[:-1])]).astype(np.int32) if len(root) else root


def halves(a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int, int, int]]:
    """Pairs of smaller ranges with the same pairs of rows."""
    if a0 == b0:
        m = (a0 + a1) // 2
        return [(a0, m, a0, m), (m, a1, m, a1), (a0, m, m, a1)]
    if a1 - a0 >= b1 - b0:
        m = (a0 + a1) // 2
        return [(a0, m, b0, b1), (m, a1, b0, b1)]
    m = (b0 + b1) // 2
    return [(a0, a1, b0, m), (a0, a1, m, b1)]


def products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (i, j) of a pair of ranges, once for a range with itself."""
    sizes = (a1 - a0) * (b1 - b0)
    pair = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    k = np.arange(len(pair), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    width = (b1 - b0)[pair]
    left, right = a0[pair] + k // width, b0[pair] + k % width
    keep = (a0 != b0)[pair] | (left < right)
    return left[keep], right[keep]


def links(rows: DataFrame, budget: int = 3, most: int = 4096, buffer_rows: int = 1 << 15) -> DataFrame:
    """(node, other): enough links between fingerprints within budget to connect all that are.

    rows: (fp), each once. A group of more than `most` has its rest of the bits split into blocks in
    turn: distinct fingerprints that agree in all but b bits are at most 2 ** b, so splitting ends.
    """
    blocks = budget + 1
    if most < 1 << blocks:
        raise ValueError("groups must be allowed as many members as blocks can tell apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, GROUP, buffer_rows):
            fp = table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((fp, group))
            node = fp[order].view(np.int64)
            a, b = trie_links(group[order], fp[order], budget)
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["node", "other"])

    def joined(part: DataFrame) -> DataFrame:
        return part.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "node long, other long")

    masks = {0: parts(list(range(BITS)), blocks)}
    part = keyed(rows.select(F.lit(0).cast("long").alias("mask"), "fp"), masks)
    out: DataFrame | None = None
    while True:
        large = materialised(part.groupBy("mask", "value").count().where(F.col("count") > most))
        if not large.head(1):
            ready = joined(part)
            return ready if out is None else out.unionAll(ready)
        ready = joined(part.join(large, ["mask", "value"], "left_anti"))
        out = ready if out is None else out.unionAll(ready)
        # A group with b bits free has at most 2 ** b members; one that is too large has a bit for each block.
        free = {m | p: [b for b in range(BITS) if not (m | p) >> b & 1] for m, ps in masks.items() for p in ps}
        masks = {m: parts(bits, blocks) for m, bits in free.items() if 1 << len(bits) > most}
        split = part.join(large, ["mask", "value"], "left_semi").select("mask", "fp").distinct()
        part = keyed(materialised(split), masks)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most_rows: int, most_bytes: int = 32 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the number of each row's group, of batches sorted by the keys: as
    many groups as make most_rows rows or most_bytes, or one group that is larger."""

    def starts(t: pa.Table) -> np.ndarray:
        columns = [t[c].to_numpy() for c in keys]
        return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in columns])])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            waiting.append(batch.slice(at, most_rows))
            if sum(b.num_rows for b in waiting) < most_rows and sum(b.nbytes for b in waiting) < most_bytes:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            new = starts(table)
            if cut := int(np.flatnonzero(new)[-1]):  # the last group may go on
                yield table.slice(0, cut), np.cumsum(new[:cut])
                table = table.slice(cut)
            waiting = table.to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield table, np.cumsum(starts(table))


def keyed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(mask, value, fp): each row once for each larger mask that its mask is split into."""
    larger = {signed(m): np.array([m | p for p in ps], np.uint64).view(np.int64) for m, ps in masks.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, fp = (c.to_numpy() for c in batch.columns)
            for m in np.unique(old):
                own = np.repeat(fp[old == m], len(larger[int(m)]))
                mask = np.tile(larger[int(m)], int((old == m).sum()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mask, own & mask, own)], ["mask", "value", "fp"])

    return rows.select("mask", "fp").mapInArrow(run, "mask long, value long, fp long")


def first_row(id_column: str) -> Column:
    """Orders rows: by id (null last), then fingerprint, then hash of the text."""
    return F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.col("fp").alias("of"), "text_hash")


def keepers(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id, keeper) of distinct (fp, first) whose components the links `found` make."""
    roots = components(found)
    labelled = materialised(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("label"), "first"))
    # Kept apart from the join, or a large component's partition could not be split.
    kept = materialised(labelled.groupBy(F.col("label").alias("of_label")).agg(F.min("first").alias("keeper")))
    return labelled.join(kept, labelled["label"] == kept["of_label"]).select("fp", F.col("keeper.id").alias("component_id"), "keeper")


def groups(marked: DataFrame, budget: int = 3, id_column: str = "doc_id") -> DataFrame:
    """(fp, component_id, keeper): of each distinct fingerprint its component's smallest id, and the
    first (id missing, id, fp, text_hash) of its rows."""
    distinct = materialised(marked.groupBy("fp").agg(F.min(first_row(id_column)).alias("first")))
    return keepers(distinct, links(distinct.select("fp"), budget))


def near_duplicates(df: DataFrame, budget: int = 3, shingle_words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row for each row in.

    A null or empty text, and one of white space, has fingerprint zero, which links like any other.
    component_id is the smallest id in the component (null only if all are null); rows that repeat are
    in one component; an empty table gives an empty result; other columns are not looked at.
    """
    marked = materialised(fingerprints(df, id_column, text_column, shingle_words))
    found = groups(marked, budget, id_column).select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(found, marked["fp"] == found["of_fp"]).select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
