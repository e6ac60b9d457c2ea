"""Operators 1, 6 and 8: all that makes tokens, against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import byte_bpe, packing, token_counts
from lamina.llm.common import flat_text, slices
from tests.llm.helpers import TEXTS, documents

JSON, RANKS = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "'", "s", "'re", "'r", "'ll", "'l", "'v", " '", "1", "23", "é", "日", "　", "\x85", "ᲊ", "!", "<|endoftext|>", "<|endof", "the", "tion", "\t", "S", "😀", "́", "\x1c", "᠎", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def compiled():
    return token_counts.CompiledTokenizer(JSON, token_counts.class_ranges_of(JSON))


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=table, special_tokens={})


mixed = st.lists(st.sampled_from(PIECES) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(mixed, min_size=1, max_size=8))
def test_transducers_count_as_the_library_does(compiled, library, texts):
    assert compiled.count(*flat_text(pa.array(texts))).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=150, deadline=None)
@given(mixed)
def test_pieces_give_the_libraries_ids(library, ranks, text):
    assert packing.ids_of(JSON).of(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    bpe = byte_bpe.byte_bpe(RANKS, vocabularies.PATTERN)
    ids = bpe.ids(text)
    assert ids == ranks.encode_ordinary(text)
    assert b"".join(bpe.bytes_of[i] for i in ids) == text.encode() and "".join(bpe.decode(ids)) == text
    spans = bpe.offsets(text, ids)
    assert all(text[a:b].encode().find(bpe.bytes_of[i]) >= 0 or b - a >= 1 for i, (a, b) in zip(ids, spans, strict=True))
    assert not spans or (spans[0][0] == 0 and spans[-1][1] == len(text))


@settings(max_examples=100, deadline=None)
@given(mixed, st.integers(1, 20))
def test_segments_change_no_id(compiled, library, text, most):
    from lamina.llm.pieces import segments

    parts, split = list(segments(text, most)), library.pre_tokenizer.pre_tokenize_str
    assert "".join(parts) == text and [name for part in parts for name, _ in split(part)] == [name for name, _ in split(text)]
    assert compiled.count_long(text, most) == len(library.encode(text, add_special_tokens=False).ids)


def test_small_memory_changes_no_count(compiled, library):
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(30)) for _ in range(300)]
    small = token_counts.CompiledTokenizer(JSON, token_counts.class_ranges_of(JSON))
    small.merges.most = 50
    for k in range(0, 300, 50):
        part = texts[k : k + 50]
        assert small.count(*flat_text(pa.array(part))).tolist() == [len(library.encode(t).ids) for t in part]


def test_prefix_scan_composes_maps():
    maps = np.random.default_rng(1).integers(0, token_counts.STATES, (token_counts.STATES, 37)).astype(np.uint8)
    scanned, state = token_counts.prefix_scan(maps), np.arange(token_counts.STATES)
    for k in range(37):
        state = maps[state, k]
        assert (scanned[:, k] == state).all()


def test_memo_keeps_to_its_bound():
    from lamina.llm.pieces import PieceMemo

    memo = PieceMemo(str.upper, most=10)
    text = " ".join(map(str, range(100)))
    assert "".join(memo.of(text)) == text.upper() and len(memo) + len(memo.older) <= 20


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 7 + [None, "y" * 100])], ["text"])
    parts = list(slices(batch, "text", 25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 2, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_token_counts(spark, library):
    df, rows = documents(spark)
    got = sorted((r[:] for r in token_counts.count_tokens(df, JSON).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 1024) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0


def tokens_whole(ranks, i):
    try:
        return bool(ranks.decode_single_token_bytes(i).decode())
    except UnicodeDecodeError:
        return False


def test_round_trip(spark, ranks):
    df, rows = documents(spark)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := ranks.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows]
    got = byte_bpe.round_trip(df, RANKS, vocabularies.PATTERN).collect()
    assert sorted((r[:4] for r in got), key=str) == sorted(want, key=str)
    partial = lambda t: sum(not tokens_whole(ranks, i) for i in ranks.encode_ordinary(t or ""))
    texts = {i: t for i, t, *_ in rows}
    assert all(r.n_partial >= partial(texts[r.doc_id]) for r in got) and sum(r.n_partial for r in got) > 0
    long = "ab c1 " * 700_000
    ids = ranks.encode_ordinary(long)
    assert byte_bpe.byte_bpe(RANKS, vocabularies.PATTERN).digests(long) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(long.encode()), 0)
    encoded = byte_bpe.encode(df, RANKS, vocabularies.PATTERN)
    back = byte_bpe.decode(encoded, RANKS, vocabularies.PATTERN)
    assert sorted((r[:] for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    assert encoded.limit(0).count() == 0


def test_split_characters():
    bpe = byte_bpe.byte_bpe(RANKS, vocabularies.PATTERN)
    single = [next(i for i, raw in bpe.bytes_of.items() if raw == bytes([b])) for b in "é".encode()]
    assert bpe.decode(single) == ["", "é"] and bpe.offsets("é", single) == [(0, 1), (0, 1)]
    assert bpe.decode(single[:1]) == ["�"]


def test_the_library_alone_gives_the_ranks_own_ids(ranks):
    """Merges that overlap, tokens that repeat, and characters of every plane, without tiktoken's help."""
    bpe = byte_bpe.byte_bpe(RANKS, vocabularies.PATTERN)
    r = random.Random(4)
    texts = ["".join(r.choices(pool, k=r.choice([5, 20, 60]))) for pool in ("ab", "=-", "กขำ", "01", "日本語", "éeè", " \n\t\u3000") for _ in range(150)]
    for raw in r.sample(sorted(bpe.bytes_of.values()), 1500):
        t = raw.decode(errors="ignore")
        texts += [t, t * 2, t * 5 + t[:1]]
    texts += [f"a{c}1{c}!{c} {c}" for c in map(chr, range(0x80, 0x20000, 7)) if not "\ud800" <= c <= "\udfff"]
    assert [t for t in texts if bpe.ids(t) != ranks.encode_ordinary(t)] == []


def test_long_pre_tokens_are_walked_by_chunks(compiled, library):
    r = random.Random(6)
    letters = lambda n: "".join(r.choices("abcdefghijklmnoprstuvwxyz", k=n))
    texts = ["a" * 70_001, "ab" * 9000, letters(9000), ("a" * 777 + "b") * 20, "=-" * 5000, letters(2048), letters(2049) + " x", "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(3000))]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert compiled.count(*flat_text(pa.array(texts))).tolist() == want
    forgetful = token_counts.CompiledTokenizer(JSON, token_counts.class_ranges_of(JSON))
    forgetful.merges.most = 20
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = [k for k, t in enumerate(texts) if " " not in t]
    assert [forgetful.merges.count_chunks(data[k], block=3) for k in whole] == [want[k] for k in whole]


def test_long_texts_without_blanks_are_cut(library):
    from lamina.llm.pieces import segments

    cjk = "日本語のテキスト。" * 3000
    assert max(map(len, segments(cjk, 500))) < 600
    base = "QUJD" * 20 + "1a2b3c" * 2000
    assert max(map(len, segments(base, 500))) < 700
    for t in (cjk, base, "x\n" * 3000):
        assert packing.ids_of(JSON).of(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, texts_by_row, library, capacity):
    """Every id of every document in exactly one piece, sequences gapless and within capacity."""
    sequences, covered = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
        covered.setdefault(doc, []).append((start, length, crc, total))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, text in texts_by_row.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, total in sorted(covered.pop(doc)):
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not covered
    return 1 - sum(r[2] for r in rows) / capacity / len(sequences)


def test_packing(spark, library):
    texts = [*TEXTS[:9], *(" ".join(random.Random(k).choices(["x", "ab", "cde"], k=random.Random(k).randrange(3000))) for k in range(200)), TEXTS[10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (32_768, 7):
        rows = [r[:] for r in packing.pack(df, JSON, group_pieces=group).collect()]
        padding = check_packing(rows, dict(enumerate(texts)), library, 2048)
        assert padding < (0.06 if group > 7 else 1)
    spread = [packing.pack(df.repartition(n), JSON) for n in (1, 37)]
    paddings = [check_packing([r[:] for r in p.collect()], dict(enumerate(texts)), library, 2048) for p in spread]
    assert max(paddings) < 0.06  # however many partitions there are
    odd, given_rows = documents(spark)
    assert packing.pack(odd, JSON).select("doc_id").distinct().count() == len({r[0] for r in given_rows})
    assert packing.pack(odd.limit(0), JSON).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_tournament_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    room: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
        if b == len(room):
            room.append(50)
        assert (bins[k], offsets[k]) == (b, 50 - room[b])
        room[b] -= lengths[k]
