"""Near copies of the pipeline's second stage against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import components as components_module
from lamina.llm import near_copies
from lamina.llm.components import components
from tests.llm.helpers import documents


def shingles(text, k=5):
    words = text.encode().lower().split()  # bytes: ASCII white space and case only
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def groups_of(values, alike):
    root = list(range(len(values)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(values)):
        for j in range(i):
            if alike(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(values))]


def words(r, n, of=10**6):
    return [f"w{r.randrange(of)}" for _ in range(n)]


def changed(r, base, share):
    """A copy with single words changed until about that share of the shingles is new."""
    out = list(base)
    for k in r.sample(range(len(base)), max(1, int(len(base) * share / 5))):
        out[k] = f"c{r.randrange(10**6)}"
    return out


def test_keep_first_against_all_pairs(spark):
    """Copies of many grades, blocks moved and replaced, and unrelated texts that share a run of one word."""
    r = random.Random(8)
    texts = [words(r, n) + ["-"] * int(n * share) for n, share in [(300, 0.1), (1000, 0.05), (3000, 0.05), (200, 0.3)] for _ in range(4)]
    for _ in range(15):
        base = words(r, r.randrange(60, 500))
        half = len(base) // 2
        texts += [base, base[half:] + base[:half], base + ["-"] * 300, changed(r, base, 0.05), changed(r, changed(r, base, 0.09), 0.09), changed(r, base, 0.3)]
    df, rows = documents(spark, [" ".join(t) for t in texts])
    sets = [shingles(t) for _, t, *_ in rows]
    roots = groups_of(sets, lambda a, b: similarity(a, b) >= 0.8)
    want = sorted(min(i for (i, *_), k in zip(rows, roots) if k == root and i is not None) for root in set(roots))
    assert len(want) < 0.8 * len(rows) and set(range(16)) <= set(want)
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == want


@pytest.mark.parametrize("kind", ["words", "block"])
def test_recall_by_similarity(spark, kind):
    """Of pairs just above 0.8, nine of ten are found; of those further up, nearly all."""
    r, pairs = random.Random(2), []
    for k in range(400):
        base = words(r, r.randrange(80, 300))
        n = len(base) - 4
        share = 0.108 * (1 if k % 2 else 0.5)
        if kind == "words":
            other = changed(r, base, share)
        else:
            start = r.randrange(len(base) // 2)
            gone = max(1, int(n * share) - 4)
            other = base[:start] + words(r, gone) + base[start + gone :]
        pairs.append((base, other, similarity(shingles(" ".join(base)), shingles(" ".join(other)))))
    df = spark.createDataFrame([(2 * k + j, " ".join(t)) for k, (a, b, _) in enumerate(pairs) for j, t in enumerate((a, b))], "doc_id long, text string")
    kept = {x.doc_id for x in near_copies.keep_first(df).collect()}
    assert all(2 * k in kept for k in range(len(pairs)))
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 1, 0.98), (0, 0.8, 0)):
        found = [2 * k + 1 not in kept for k, (*_, s) in enumerate(pairs) if low <= s < high]
        assert (np.mean(found) >= least and len(found) > 50) if low else not any(found)


def test_odd_texts_and_clashing_names(spark):
    df, rows = documents(spark)
    df = df.withColumns({c: F.lit("x") for c in ("text_hash", "_text_hash", "kept_id", "Kept_Hash", "fp", "node")})
    kept = near_copies.keep_first(df)
    got = [x.doc_id for x in kept.collect()]
    assert kept.columns == df.columns and len(got) == len(set(got)) and 0 in got and not {1, 2} & set(got)  # null, empty and blank are one
    assert near_copies.keep_first(df.limit(0)).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert near_copies.keep_first(unnamed).count() == 2


@pytest.mark.parametrize("most", [10_000, 7])
def test_connect_loses_no_link(spark, most):
    """Parts that are one chain, one dense group, several groups or all apart, in cells of any size."""
    r = random.Random(3)
    values = [(0, k) for k in range(40)] + [(1, 0)] * 60 + [(2, r.randrange(4) * 100) for _ in range(50)] + [(3, 50 * k) for k in range(30)]
    rows = [(part, node, value) for node, (part, value) in zip(r.sample(range(10_000), len(values)), values)]
    df = spark.createDataFrame(rows, "part long, node long, value long")

    def linker(table, group):
        value = table["value"].to_numpy()
        near = (np.abs(value[:, None] - value) <= 1) & (group[:, None] == group)
        return np.nonzero(near)

    root = {x.node: x.root for x in components(near_copies.connect(df, linker, F.lit(1), most, 16)).collect()}
    got = [root.get(node, node) for _, node, _ in rows]
    want = groups_of(rows, lambda a, b: a[0] == b[0] and abs(a[2] - b[2]) <= 1)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_a_large_group_costs_a_row_for_each_member(spark):
    """3,000 near copies of one text, in cells of a few: one stays, and no node makes rows by pairs."""
    r = random.Random(5)
    base = words(r, 60)
    df = spark.createDataFrame([(k, " ".join(changed(r, base, 0.06))) for k in range(3000)], "doc_id long, text string")
    marked = near_copies.signatures(df, 10)
    distinct = near_copies.distinct_texts(marked)
    proposed = near_copies.proposals(distinct, 10, 22, 34, most=256).cache()
    assert proposed.count() < 40 * 3000
    found = near_copies.verified(df, distinct, proposed, 0.8, 34, "doc_id", "text", most_shingles=1 << 14)
    sizes = components(found).groupBy("root").count().collect()
    assert len(sizes) == 1 and sizes[0]["count"] == distinct.count() - 1


def test_links_of_one_group_are_shuffled_by_node(spark, monkeypatch):
    """2,000 near copies, each proposed by up to 40 keys: a round has a row for each, not one for each link."""
    r, rounds, real = random.Random(5), [], components_module.materialised

    def counted(df):
        out = real(df)
        if out.columns == ["child", "parent"]:
            rounds.append(out.count())
        return out

    monkeypatch.setattr(components_module, "materialised", counted)
    base = words(r, 60)
    df = spark.createDataFrame([(k, " ".join(changed(r, base, 0.06))) for k in range(2000)], "doc_id long, text string")
    distinct = near_copies.distinct_texts(near_copies.signatures(df, 10))
    proposed = near_copies.proposals(distinct, 10, 22, 34).cache()
    n = distinct.count()
    assert proposed.count() > 10 * n
    got = components(proposed).collect()
    smallest = distinct.agg(F.min("fp")).first()[0]
    assert len({x.node for x in got}) == n - 1 and {x.root for x in got} == {smallest}
    assert len(rounds) > 1 and max(rounds) < n


@pytest.mark.parametrize("most", [1 << 18, 50, 1])
def test_components_of_any_links(spark, most):
    """Stars, chains, pairs and single links in any direction, twice or to themselves, in tasks of any size."""
    r = random.Random(6)
    of = lambda k: k * 7919 % 1009 - 500  # noqa: E731  negative ones too, in no order
    pairs = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 180)] + [(k, k) for k in range(300, 310)]
    pairs += [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(90)]
    pairs = [(of(a), of(b)) if r.random() < 0.5 else (of(b), of(a)) for a, b in [*pairs, *pairs[::5]]]
    root = {x.node: x.root for x in components(spark.createDataFrame(pairs, "node long, other long"), most).collect()}
    nodes = sorted({x for pair in pairs for x in pair})
    linked = set(pairs) | {(b, a) for a, b in pairs}
    want = [nodes[k] for k in groups_of(nodes, lambda a, b: (a, b) in linked)]
    assert [root.get(x, x) for x in nodes] == want


def test_exact_links_of_sets():
    r = random.Random(1)
    base = words(r, 80)
    texts = [" ".join(changed(r, base, 0.02 + 0.01 * k)) for k in range(30)] + ["", "one", " ".join(base)]
    sets = [near_copies.shingle_set(near_copies.word_hashes(t), 5) for t in texts]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    sketch = np.zeros((len(sets), 2), np.uint64)
    for least in (0.7, 0.8, 0.9):
        a, b = near_copies.jaccard_links(sets, sketch, 128, least)
        root = dict(zip(a.tolist(), b.tolist()))
        want = groups_of([shingles(t) for t in texts], lambda x, y: bool(x and y) and similarity(x, y) >= least)
        assert [root.get(k, k) for k in range(len(texts))] == want


def test_sketch_bits_differ_as_similarity_says():
    r = random.Random(7)
    base, other = words(r, 3000), words(r, 3000)
    found = [near_copies.fingerprints_of(near_copies.shingle_set(near_copies.word_hashes(" ".join(base[:3000 - n] + other[:n])), 5), 64) for n in (0, 333)]
    share = np.bitwise_count(found[0] ^ found[1]).sum() / 4096
    assert abs(share - 0.1515) < 0.02
