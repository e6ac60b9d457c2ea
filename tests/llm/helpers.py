"""Small tables with the cases that every operator must bear."""

from pyspark.sql import functions as F

WORDS = "the cat sat on a mat and saw that its own tail was long".split()
TEXTS = [
    None,
    "",
    "   ",
    "one",
    "two words",
    "The cat sat on the mat. It was a very long day for the cat, and it slept. Then it woke up again and ate.",
    "the CAT sat on the mat. it was a very long day for the cat, and it slept. then it woke up again and ate.",
    "don't we'll I've 's '' 'tis  double  spaces\n\n\ttabs\r\nend ",
    "naïve façade — “quotes” 日本語のテキスト 😀 é́  x　y\x85z",
    "<|endoftext|> in <|endoftext|><|endof text",
    "word " * 5000,
    "a" * 20_000,
    " ".join(WORDS * 3000),
]


def documents(spark, texts=TEXTS):
    """(doc_id, text, lang, source, n_chars) and columns whose names clash with the operators' own.
    One id repeats with its text, one is null."""
    rows = [(k, t, ["en", "fr", None][k % 3], "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[-1], (None, texts[5] if len(texts) > 5 else "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"n_tokens": F.lit("clash"), "fp": F.lit(1), "score": F.lit("x"), "id": F.lit(2), "value": F.lit(3), "place": F.lit(4)}), rows
