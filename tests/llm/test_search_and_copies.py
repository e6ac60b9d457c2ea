"""Operators 2, 3 and 9 against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import exact_topk, simhash
from lamina.llm.components import components
from lamina.llm.queries import OP2_SQL
from lamina.llm.substring import SubstringDedup, runs, sentences
from tests.llm.helpers import documents


# --- exact top-k


def topk_brute(rows, k=5, scale=256):
    sound = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in sound if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("blocks", [(4096, 8192), (1, 7)])
def test_topk(spark, blocks):
    r = random.Random(1)
    rows = [(i, [r.uniform(-2, 2) if r.random() < 0.7 else 0.0 for _ in range(6)]) for i in range(130)]
    rows += [(i, [0.5] * 6) for i in range(200, 230)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (None, [9.0] * 6), (350, []), (303, [float("inf")] * 6), (304, [3.0]), (400, [2.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = exact_topk.top_k(df, "id % 50 = 0", query_block=blocks[0], candidate_block=blocks[1], most_scores=64)
    assert {x[:] for x in got.collect()} == topk_brute(rows)
    assert exact_topk.top_k(df.limit(0), "id % 50 = 0").count() == 0


def test_topk_repeats_and_large_values(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1e12]), (3, [1.7e308]), (4, [-1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [x[:] for x in exact_topk.top_k(df, "id = 0").orderBy("rank").collect()]
    assert got[:4] == [(0, 1, 3, 2**63 - 1), (0, 2, 2, 256 * 256 * 10**12), (0, 3, 1, 131072), (0, 4, 1, 131072)]


def test_topk_sql(spark, sf):
    from lamina.llm.queries import op2_exact_topk

    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = set(db.sql(OP2_SQL).fetchall())
    assert {x[:] for x in op2_exact_topk(spark, sf).collect()} == want


# --- SimHash


def fingerprint(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB \n\x0b\xa0é", max_size=80), st.integers(1, 20), st.integers(1, 5))
def test_parts_change_no_shingle(text, part, k):
    flat = lambda parts: [int(x) for h in parts for x in h]
    assert flat(simhash.shingle_hashes(text, k, part)) == flat(simhash.shingle_hashes(text, k))
    assert simhash.fingerprint(text) == fingerprint(text)


def linked(values, near):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(values))]


def test_near_duplicates(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(25):
        words = r.choices(vocabulary, k=r.randrange(1, 400))
        texts.append(" ".join(words))
        for _ in range(r.randrange(4)):
            changed = list(words)
            changed[r.randrange(len(words))] = "changed"
            texts.append(" \n".join(changed).upper() if r.random() < 0.3 else " ".join(changed))
    df, rows = documents(spark, [None, "", " ", "one", "İ ß", *texts])
    fps = [fingerprint(t or "") for _, t, *_ in rows]
    roots = linked(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {c: min(i for (i, *_), k in zip(rows, roots) if k == c and i is not None) for c in roots}
    want = collections.Counter((i, f"{f:016x}", least[c]) for (i, *_), f, c in zip(rows, fps, roots))
    assert collections.Counter(x[:] for x in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert {x.component_id for x in simhash.near_duplicates(df).collect()} == {None}


def test_many_equal_leaves_are_compared_in_parts():
    n = 100
    checks = np.arange(n) % 3
    alike = lambda x, y: checks[x] == checks[y]
    a, b = simhash.trie_links(np.zeros(n, int), np.full(n, 9, np.uint64), 3, alike, most_pairs=50)
    assert dict(zip(a.tolist(), b.tolist())) == {k: k % 3 for k in range(3, n)}
    a, b = simhash.trie_links(np.zeros(n, int), np.full(n, 9, np.uint64), 3, alike, labels=np.where(checks == 1, -1, np.arange(n)), most_pairs=50)
    assert dict(zip(a.tolist(), b.tolist())) == {k: k % 3 for k in range(3, n) if k % 3 != 1}


def test_dense_groups_need_little_memory():
    """16 groups of 4,096 near copies each: all become one component a group, without room for all pairs."""
    import tracemalloc

    rng = np.random.default_rng(4)
    groups = np.repeat(np.arange(16), 4096)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (len(groups), 6), dtype=np.uint64), axis=1)
    fps = rng.integers(0, 2**63, 16, dtype=np.uint64)[groups] ^ flips
    order = np.lexsort((fps, groups))
    tracemalloc.start()
    a, b = simhash.trie_links(groups, fps[order], 22, lambda x, y: np.bitwise_count(fps[order][x] ^ fps[order][y]) <= 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == len(groups) - 16 and set(b.tolist()) == set(range(0, len(groups), 4096))
    assert peak < 100 << 20


def test_whole_groups_are_cut_at_groups():
    import pyarrow as pa

    keys = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + 9])], ["key"]) for k in range(0, len(keys), 9)]
    found = list(simhash.whole_groups(iter(batches), ("key",), 10))
    assert np.concatenate([t["key"].to_numpy() for t, _ in found]).tolist() == keys.tolist()
    for t, group in found:
        own = t["key"].to_numpy()
        assert (np.diff(own) != 0).tolist() == (np.diff(group) != 0).tolist()
    assert all(x["key"][-1] != y["key"][0] for (x, _), (y, _) in zip(found, found[1:])) and max(t.num_rows for t, _ in found) <= 27
    assert list(simhash.whole_groups(iter([]), ("key",), 10)) == []


@pytest.mark.parametrize("most", [4096, 20])
def test_trie_join_finds_every_link(spark, most):
    rng = np.random.default_rng(2)
    fps = set()
    for b in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(40):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    want = linked(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df, 3, most=most)).collect()}
    label = [root.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(label, want))) == len(set(label)) == len(set(want))


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select(F.col("id").alias("node"), (F.col("id") + 1).alias("other"))
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 201)}
    assert components(links.limit(0)).count() == 0


# --- substring deduplication


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab .!?"\n。”', max_size=60))
def test_sentences_cover_the_text(text):
    parts = sentences(text)
    assert "".join(text[a:b] for a, b in parts) == text and all(a < b for a, b in parts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=20))
def test_runs_are_the_shortest(counts):
    enough = lambda i, j: j - i >= 2 and sum(counts[i:j]) >= 6
    n = len(counts)
    forward = {(i, min(js)) for i in range(n) if (js := [j for j in range(i + 1, n + 1) if enough(i, j)])}
    backward = {(max(js), j) for j in range(1, n + 1) if (js := [i for i in range(j) if enough(i, j)])}
    assert runs(counts, 2, 6) == forward | backward


BREAK = re.compile(r"""(?:[.!?…]+["'”’»)\]]*(?=\s|$)|[。！？]+["'”’»)\]]*|(?=\n))\s*""")


def plain_sentences(text):
    """Cut after signs that end a sentence and at line breaks; white space goes with what it follows."""
    out, start = [], 0
    for m in BREAK.finditer(text):
        if text[start : m.end()].strip():
            out.append(text[start : m.end()])
            start = m.end()
    if text[start:].strip() or not out:
        return [*out, text[start:]] if text[start:] else out
    return [*out[:-1], out[-1] + text[start:]]


def dedup_brute(rows, least_sentences=2, least_words=12):
    """Every span of every text, however long, as words; removed wherever it is not the first."""
    hashed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64)) if t is not None else 42
    places = collections.defaultdict(set)
    for i, t in set(rows):
        parts = [tuple(p.lower().split()) for p in plain_sentences(t or "")]
        for a in range(len(parts)):
            for b in range(a + least_sentences, len(parts) + 1):
                if sum(map(len, parts[a:b])) >= least_words:
                    places[tuple(parts[a:b])].add(((i is None, i or 0, hashed(t), a), (i, t), b))
    gone = collections.defaultdict(set)
    for found in places.values():
        first = min(found)
        for (*_, a), of, b in found - {first}:
            gone[of].update(range(a, b))
    return collections.Counter((i, t and "".join(p for k, p in enumerate(plain_sentences(t)) if k not in gone[i, t]), len(gone[i, t])) for i, t in rows)


def test_substring_dedup(spark):
    r = random.Random(9)
    sentence = lambda: " ".join(r.choices([f"w{k}" for k in range(300)], k=r.randrange(1, 14))) + r.choice([". ", "! ", ".\n"])
    shared = ["".join(sentence() for _ in range(r.randrange(5, 9))) for _ in range(4)]
    texts = ["".join(sentence() for _ in range(r.randrange(6))) + r.choice([*shared, ""]) + "".join(sentence() for _ in range(r.randrange(6))) for _ in range(60)]
    loops = ["La. " * 30, "one two three. " * 20 + "four five six seven eight. " * 4]
    df, rows = documents(spark, [None, "", "one", "word " * 500, texts[0], texts[0].upper(), *loops, *texts])
    dedup = SubstringDedup()
    got = collections.Counter((x.doc_id, x.text, x.n_removed) for x in dedup.dedup(df).collect())
    assert got == dedup_brute([(i, t) for i, t, *_ in rows])
    named = df.withColumns({c: F.lit("x") for c in ("doc", "_doc", "of_text", "places", "text_hash", "_repeat_text", "high", "low", "Place.s")})
    again = dedup.dedup(named)
    assert again.columns[: len(named.columns)] == named.columns
    assert collections.Counter((x.doc_id, x.text, x.n_removed) for x in again.collect()) == got
    out = dedup.dedup(df)
    assert out.columns[: len(df.columns)] == df.columns
    assert dedup.dedup(df.limit(0)).count() == 0


def test_removed_spans_rebuild_the_text(spark):
    passage = "The quick brown fox jumps over the lazy dog near the river. It then runs away from all the hounds. Nobody ever saw it there again at night."
    df = spark.createDataFrame([(1, f"First of all. {passage} The end."), (2, f"Another start. {passage} Another end."), (3, "Clean text. Nothing shared here at all, not one run.")], "doc_id long, text string")
    out = {x.doc_id: x for x in SubstringDedup().dedup(df).collect()}
    assert passage in out[1].text and passage not in out[2].text and out[2].text == "Another start. Another end."
    assert [(s.start, s.stop) for s in out[2].removed] == [(15, 15 + len(passage) + 1)]
    assert (out[3].n_removed, out[1].n_removed) == (0, 0)
