"""Documents that every operator has to stand: nulls, empty and long texts, repeated rows, clashing names."""

from pyspark.sql import functions as F

TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog. It runs on and on.", "en", "a"),
    (1, None, "en", "b"),
    (2, "", None, None),
    (3, "word " * 9000, "en", "b"),
    (4, "The quick brown fox jumps over the lazy dog. It runs on and on.", "en", "c"),
    (4, "The quick brown fox jumps over the lazy dog. It runs on and on.", "en", "c"),
    (5, "Größe\tist  STRASSE\n\x0bŒuvre ﬁn \U0001f600 café", "de", None),
    (None, "a row without a key, and with five more words", "en", "a"),
    (None, None, None, None),
    (7, "one", "en", "d"),
    (8, "one two", "en", "d"),
    (9, "x" * 70000, "en", "d"),
    (20, " \t\n ", "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("key", "fp", "hash", "n", "size", "target", "mix_size", "llm_key", "u", "v", "range", "word", "rank", "score", "root", "bucket", "value", "payload", "count")


def documents(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


def clashing(df):
    """df with columns of names that operators use inside."""
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})
