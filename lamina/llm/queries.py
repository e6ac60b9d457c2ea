"""The registered query of each training-data operator, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm.common import table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; every machine has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.exact_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5, scale=256)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), budget=3, shingle_words=3)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    """Written for DuckDB apart from the operator, with which it shares only its tables of fixed values."""
    from lamina.llm.licenses import DIGESTS, EQUIVALENT, KNOWN

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
    digests = f"UNION ALL SELECT * FROM (VALUES {pairs(DIGESTS)}) d(license_id, digest)" if DIGESTS else ""
    same = "words"
    for other, one in EQUIVALENT:
        same = f"replace({same}, ' {other} ', ' {one} ')"
    return rf"""
WITH raw AS (
  SELECT doc_id, NULL AS license_id, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT NULL, license_id, t FROM (VALUES {pairs(KNOWN)}) k(license_id, t)
), ascii AS (
  SELECT * REPLACE (regexp_replace(replace(translate(t, '‘’‚“”„«»‐‑–—―…•·', repeat(chr(39), 3) || repeat(chr(34), 5) || '-----.**'), '©', '(c)'), '(^|\n)[ \t]*(?:/+\**|[#*;]+)[ \t]*', '\1', 'g') AS t) FROM raw
), unowned AS (
  SELECT * REPLACE (regexp_replace(t, '(^|[\s\x0B>;])(?:portions[\s\x0B]+)?(?:copyright[\s\x0B]*(?:\(c\)|\d\d\d\d|<|\[|the [^\n]{{0,60}}authors)|\(c\)[\s\x0B]*(?:copyright[\s\x0B]*)?\d\d\d\d)[^\n]*?(all[\s\x0B]+rights[\s\x0B]+reserved|permission[\s\x0B]+is[\s\x0B]+hereby|permission[\s\x0B]+to[\s\x0B]+use|redistribution[\s\x0B]+and[\s\x0B]+use|licensed[\s\x0B]+under|everyone[\s\x0B]+is[\s\x0B]+permitted|this[\s\x0B]+(?:software|program|file|work|library|code)|\n|\z)', chr(10) || chr(10) || '\2', 'gi') AS t) FROM ascii
), untitled AS (
  SELECT * REPLACE (regexp_replace(regexp_replace(t, 'all[\s\x0B]+rights[\s\x0B]+reserved', ' ', 'gi'), '\A[^a-z0-9]*(?:\S+[ \t]+){{0,7}}licen[cs]e(?:[ \t]+\([^()\n]{{1,20}}\))?[^a-z0-9\n]*\n[^a-z0-9\n]*\n([^a-z0-9]*[a-z0-9])', '\1', 'i') AS t) FROM unowned
), unmarked AS (
  SELECT * REPLACE (translate(regexp_replace(t, '(^|[\s\x0B])\(?(?:\d\d?|[A-Za-z]|[ivx]{{1,4}})[.)][\s\x0B]+([A-Z])', ' \2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t) FROM untitled
), spaced AS (
  SELECT doc_id, license_id, ' ' || trim(regexp_replace(t, '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', '  ', 'g')) || ' ' AS words FROM unmarked
), digested AS (
  SELECT doc_id, license_id, sha256({same}) AS digest FROM spaced
), licences AS (
  SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, digest FROM digested WHERE license_id IS NOT NULL {digests}) GROUP BY 1
)
SELECT d.doc_id, d.digest AS canonical_digest, l.license_id FROM digested d LEFT JOIN licences l USING (digest) WHERE d.license_id IS NULL
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.warc import deduplicated

    return deduplicated(table(spark, sf_dir, "pages"), least_bytes=100)


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), heads AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
), r AS (
  SELECT p.*, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
  FROM p LEFT JOIN heads USING (digest)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamina.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.mpegts import text_media

    return text_media(table(spark, sf_dir, "documents"), block=576, tail=32)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.substring import SubstringDedup

    found = SubstringDedup(least_sentences=2, least_words=12).dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "removed", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_topk": op2_exact_topk,
        "op3_simhash": op3_simhash,
        "op4_license_scan": op4_license_scan,
        "op5_warc": op5_warc,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_mpegts": op7_mpegts,
        "op8_packing": op8_packing,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": OP2_SQL,
        "op4_license_scan": op4_sql(),
        "op5_warc": OP5_SQL,
    }
