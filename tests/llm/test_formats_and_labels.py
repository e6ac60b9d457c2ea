"""Operators 4, 5, 7 and 10, and the pipeline."""

import collections
import hashlib
import os
import pathlib
import random
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import langid, licenses, mpegts, warc
from lamina.llm.queries import OP5_SQL, oracle_sql, queries
from tests.llm.helpers import documents


# --- licences


LICENCES = pathlib.Path("/usr/share/common-licenses")
#: Names of files there, and the licences that they are.
COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def forms(text, title):
    """A licence as it is met: titled, owned, wrapped, on one line, as a comment."""
    owned = f"{title}\n\nCopyright (c) 2020-2024 Foo Bar, Inc. <foo@bar.org>\nAll rights reserved.\n\n{text}"
    return [
        text,
        owned,
        "\n".join(textwrap.wrap(text, 60)),
        owned.split("\n\n")[0] + "\n\n© 2019 The Foo Authors\n\n" + "\n".join(textwrap.wrap(text, 72)),
        "/*\n" + "".join(f" * {line}\n" for line in owned.split("\n")) + " */\n",
        f"{title} Copyright (c) 2020 Foo. " + " ".join(text.split()),
        f"Copyright The Foo Authors\n\n{text}".replace('"', "“"),
        text.replace("copyright notice", "copyright\nnotice").replace("license", "licence"),
    ]


def test_licences_in_their_usual_forms(spark):
    titles = {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "Zlib": ["zlib License"], "0BSD": ["BSD Zero Clause License"]}
    known = dict(licenses.KNOWN)
    cases = [(i, form) for i, names in titles.items() for title in names for form in forms(known[i], title)]
    starred = known["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    cases += [("BSD-3-Clause", starred), (None, known["MIT"] + " and more"), (None, "MIT License"), (None, "Copyright (c) 2020 X"), (None, None), (None, "")]
    cases += [("Apache-2.0-notice", "licenced UNDER the Apache Licence,\nversion 2.0"), (None, "Licensed under CC BY-NC 4.0.\nAnd a text."), ("GPL-3.0-notice", known["GPL-3.0-notice"])]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(df).collect()}
    assert [(k, got[k], want) for k, (want, _) in enumerate(cases) if got[k] != want] == []
    assert {r.doc_id: r.license_id for r in licenses.scan(df, most_broadcast=0).collect()} == got


@pytest.mark.skipif(not LICENCES.is_dir(), reason="no licence texts on this machine")
def test_common_licences(spark):
    indented = lambda raw: "".join(f"    // {line.strip()}  \r\n" for line in raw.split("\n"))
    cases = [(want, form) for name, want in COMMON.items() for raw in [(LICENCES / name).read_text()] for form in (raw, indented(raw))]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.canonical_digest) for r in licenses.scan(df).collect()}
    assert sorted((want, got[2 * k][1]) for k, (want, _) in enumerate(cases[::2])) == sorted(licenses.DIGESTS)
    assert [(k, got[k][0], want) for k, (want, _) in enumerate(cases) if got[k][0] != want] == []


def test_licences_of_a_table(spark):
    texts = spark.createDataFrame([("own", "My own terms: do as you like."), ("own-2", "MY OWN TERMS do as you like")], "license_id string, text string")
    table = texts.select("license_id", licenses.digest(texts["text"]).alias("license_digest"))
    df = spark.createDataFrame([(1, "My own terms; do as you like!"), (2, "other")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(df, table).collect()} == {1: "own", 2: None}


def test_licences_sql_and_plan(spark, sf):
    df, rows = documents(spark)
    known = dict(licenses.KNOWN)
    more = [(100 + k, t, None, None, 0) for k, t in enumerate(f for i in ("MIT", "ISC", "BSD-3-Clause") for f in forms(known[i], f"{i} License"))]
    whole = df.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    found = licenses.scan(whole)
    assert found.count() == len(rows) + len(more) and licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    with duckdb.connect() as db:
        db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in [*rows, *more]])
        want = collections.Counter(db.sql(oracle_sql()["op4_license_scan"]).fetchall())
    assert collections.Counter(r[:] for r in found.select("doc_id", "canonical_digest", "license_id").collect()) == want


# --- WARC

PAGES = [(1, "u", "x" * 200), (2, "u", "x" * 200), (2, "u", "x" * 200), (None, "a b\n", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "y"), (6, "u", "y"), (None, "u", "z" * 100), (None, "u", "z" * 100), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 20), (9, "u", "é" * 60), (10, "u", "é" * 60)]


def test_revisits(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    with duckdb.connect() as db:
        db.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
        want = collections.Counter(db.sql(OP5_SQL).fetchall())
    assert collections.Counter(r[:] for r in warc.deduplicated(df, f"file://{tmp_path}/w").collect()) == want
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz"]
    records = [r for p in files for r in warc.parse(zlib.decompress(p.read_bytes(), wbits=47))]
    assert len(records) == len(PAGES)
    for fields, block in records:
        assert len(block) == int(fields[b"content-length"]) and fields[b"warc-type"] in (b"response", b"revisit")
        assert (fields[b"warc-type"] == b"revisit") == block.endswith(b"\r\n\r\n") or block.endswith(b"\r\n")
    assert warc.deduplicated(df.limit(0)).count() == 0


def test_archives_are_cut_by_size_and_checked(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", os.urandom(300).hex()) for k in range(50)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, archive_bytes=5000)
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".gz"]
    assert len(files) > 5 and warc.read_archives(spark, folder).count() == 50
    raw = zlib.decompress(files[0].read_bytes(), wbits=47)
    with pytest.raises((ValueError, KeyError)):
        list(warc.parse(raw[:-10]))


# --- MPEG transport streams


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_stream_round_trip(payload):
    payload = payload.ljust(max(1, -(-len(payload) // 576)) * 576, b"\xff")
    raw = mpegts.write_stream(payload)
    media = mpegts.read_stream(raw)
    (stream,) = media.streams.values()
    assert b"".join(stream.units) == payload and not media.discontinuities and not media.bad_sections
    assert len(raw) % 188 == 0 and stream.stamps == [k * mpegts.TICKS for k in range(len(stream.units))]
    assert [t for t, _ in stream.points] == stream.stamps[:: mpegts.UNITS_PER_POINT]
    assert all(raw[p * 188 + 5] & 0x40 for _, p in stream.points)


def test_stream_faults():
    raw = mpegts.write_stream(os.urandom(576 * 100))
    packets = [raw[k : k + 188] for k in range(0, len(raw), 188)]
    units = len(next(iter(mpegts.read_stream(raw).streams.values())).units)
    lost = mpegts.read_stream(b"".join(packets[:9] + packets[10:]))
    assert lost.discontinuities == 1 and len(next(iter(lost.streams.values())).units) == units - 1
    twice = mpegts.read_stream(b"".join(packets[:9] + packets[8:]))
    assert twice.discontinuities == 0 and len(next(iter(twice.streams.values())).units) == units
    broken = bytearray(raw)
    broken[12] ^= 1
    assert mpegts.read_stream(bytes(broken)).bad_sections == 1
    with pytest.raises(ValueError):
        mpegts.read_stream(b"\x00" * 188)
    cut = mpegts.read_stream(b"".join(packets[:-3]))
    assert cut.cut_units == 1 and len(next(iter(cut.streams.values())).units) == units - 1
    assert mpegts.read_stream(raw).clocks == {mpegts.ES_PID: [k * mpegts.TICKS * 300 for k in range(units)]}
    null = mpegts.packet_head(mpegts.NULL_PID, False, 1, 0).ljust(188, b"\x00")
    assert mpegts.read_stream(raw + null).packets == len(packets) + 1


def table_packets(pid, payloads):
    """Packets of payloads that begin with a pointer, or (None, bytes) for ones that only go on."""
    out = []
    for k, (pointer, data) in enumerate(payloads):
        body = data if pointer is None else bytes([pointer]) + data
        out.append((mpegts.packet_head(pid, pointer is not None, 1, k) + body).ljust(188, b"\xff"))
    return b"".join(out)


def test_sections_over_packets_and_several_in_one():
    """A map that ends where the next one begins, two sections in one payload, one that never ends."""
    es = lambda n: b"".join(bytes([6]) + (0xE000 | 0x200 + n * 8 + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(8))
    maps = [mpegts.section(2, n, (0xE000 | 0x200 + n * 8).to_bytes(2, "big") + b"\xf0\x00" + es(n) * 5) for n in (1, 2)]
    assert all(188 < len(m) < 360 for m in maps)
    pat = mpegts.section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | mpegts.PMT_PID).to_bytes(2, "big") for n in (1, 2)))
    other = mpegts.section(0, 9, (3).to_bytes(2, "big") + (0xE000 | 0x1500).to_bytes(2, "big"))
    raw = table_packets(mpegts.PAT_PID, [(0, pat + other)])
    first, rest = maps[0][:183], maps[0][183:]
    raw += table_packets(mpegts.PMT_PID, [(0, first), (len(rest), rest + maps[1][: 183 - len(rest)]), (None, maps[1][183 - len(rest) :])])
    media = mpegts.read_stream(raw)
    assert media.programs == {1: mpegts.PMT_PID, 2: mpegts.PMT_PID, 3: 0x1500} and not media.bad_sections
    assert sorted(media.streams) == [0x200 + n * 8 + k for n in (1, 2) for k in range(8)]
    lost = mpegts.read_stream(raw[: -188])
    assert lost.bad_sections == 1 and len(lost.streams) == 8


def test_crc_of_a_known_string():
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_text_media(spark):
    df, rows = documents(spark)
    got = mpegts.text_media(df).collect()
    assert len(got) == len(rows) and mpegts.text_media(df.limit(0)).count() == 0
    by_text = {}
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(text or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


# --- language identification

SYLLABLES = {"en": ["the", "ing", "wh", "sh", "ed"], "fr": ["eau", "éle", "ç", "oi", "re"], "de": ["sch", "ß", "ung", "ü", "er"]}


def prose(lang, r, words=60):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(words)) + "."


def test_held_out_accuracy_and_calibration(spark):
    r = random.Random(2)
    rows = [(k, prose(lang := r.choice(list(SYLLABLES)), r, r.randrange(1, 60)), lang) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    out = [(lang, got[k]) for k, _, lang in rows if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    right = np.mean([lang == x.lang_pred for lang, x in out])
    assert right > 0.97 and abs(np.mean([x.score for _, x in out]) - right) < 0.06 and all(0 <= x.score <= 1 for x in got.values())


def test_held_out_labels_are_never_learned(spark):
    r = random.Random(3)
    rows = [(k, prose("en" if k % 2 else "fr", r), "en" if k % 2 else "fr") for k in range(200)]
    wrong = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows]
    predict = lambda data: {x[:] for x in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert predict(rows) == predict(wrong)


def test_language_of_odd_texts(spark):
    df, rows = documents(spark)
    got = collections.Counter((x.doc_id, x.lang_pred == "und", x.score == 0) for x in langid.identify(df).collect())
    assert got == collections.Counter((i, blank := not any(c.isalpha() for c in t or ""), blank) for i, t, *_ in rows)
    clash = df.withColumn("_told", F.lit("mine")).withColumn("told", F.lit("too")).withColumn("a.b", F.lit(1))
    kept = langid.kept(clash, langid.fit(clash), least_score=0.0)
    assert kept.columns == clash.columns and {(x["_told"], x["told"]) for x in kept.collect()} == {("mine", "too")}
    with pytest.raises(ValueError):
        langid.fit(df, langid.Settings(most_languages=1))
    nothing = langid.identify(df.where("lang = 'none'"))
    assert nothing.count() == 0
    unlabelled = langid.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {x.lang_pred for x in unlabelled.collect()} == {"und"}


def test_prediction_does_not_depend_on_neighbours():
    from lamina.llm.common import flat_text
    import pyarrow as pa

    texts = ["Eins zwei.", "", "trois Quatre", "x", "日本"]
    together = langid.features(*flat_text(pa.array(texts)), 12)
    for k, t in enumerate(texts):
        alone = langid.features(*flat_text(pa.array([t])), 12)
        a, b = together[1][k], together[1][k + 1]
        assert (together[0][:, a:b] == alone[0]).all() and together[2][k] == alone[2][0]


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    assert 0.85 < langid.temperature(z * 5, labels) / 5 < 1.15


# --- the whole


def near_groups(texts):
    """Of each group of texts that links of 0.8 of all five-word shingles connect, the place of the first."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = collections.defaultdict(set)
    for k, own in enumerate(sets):
        met = collections.Counter(j for s in own for j in at[s])
        for j, common in met.items():
            if common >= 0.8 * (len(own) + len(sets[j]) - common):
                a, b = sorted((find(j), find(k)))
                root[b] = a
        for s in own or {()}:
            if not own:
                for j in at[s]:
                    a, b = sorted((find(j), find(k)))
                    root[b] = a
            at[s].add(k)
    return sorted({find(k) for k in range(len(sets))})


def test_pipeline(spark, sf):
    """Each stage against a plain version of it, on what the stage before it gave."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from lamina.llm.queries import vocabulary
    from tests.llm.test_search_and_copies import dedup_brute

    odd = spark.createDataFrame([(10**6, None, None, "x", 0), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "123 456", None, None, None), (None, "The cat sat with the dog and that was all there was to it.", None, "x", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(odd.select(*(F.col(f.name).cast(f.dataType) for f in docs.schema))).cache()
    told = [r for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.3]
    first = corpus_pipeline.identify_language(spark, docs, sf).cache()
    assert first.columns == docs.columns and collections.Counter(r.doc_id for r in first.collect()) == collections.Counter(r.doc_id for r in told)
    assert None not in {r.lang for r in first.collect()} and not {10**6, 10**6 + 1, 10**6 + 2} & {r.doc_id for r in told}

    order = sorted(first.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    second = corpus_pipeline.drop_near_copies(spark, first, sf).cache()
    assert sorted(str(r[:]) for r in second.collect()) == sorted(str(order[k][:]) for k in near_groups([r.text for r in order]))

    third = corpus_pipeline.drop_repeated_passages(spark, second, sf).cache()
    left = dedup_brute([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in third.collect()) == collections.Counter((i, t, len(t)) for i, t, gone in left.elements() if not (gone and not t.strip()))

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = collections.Counter()
    for r in corpus_pipeline.pack_sequences(spark, third, sf).collect():
        got[r.doc_id] += r.length
    assert got == {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in third.collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs.limit(0), sf).collect() == [] and stage(spark, docs.limit(0), sf).columns == docs.columns


def test_the_whole_pipeline(spark, sf):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "packing"]
    rows = corpus_pipeline.run(spark, sf).collect()
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len({r.doc_id for r in rows}) > 100


def test_every_query_runs_over_its_whole_table(spark, sf):
    rows = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages")}
    for name, query in queries().items():
        found = query(spark, sf)
        table, key = ("pages", "page_id") if name == "op5_warc" else ("documents", "doc_id")
        if name == "op2_exact_topk":
            assert found.count() > 0
            continue
        want = sorted(r[0] for r in rows[table].select(key).collect())
        got = sorted(r[0] for r in found.select(key).collect())
        assert (sorted(set(got)) if name == "op8_packing" else got) == want, name
