"""Odd tables for the tests of this folder."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHES = (
    "id fp comp component_id survivor digest first copies kept keep_id size source_id target taken _pos _before block_no "
    "words length start piece low toxic host path point vector query score rank key win text2 url2 record_id values"
).split()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in df.columns))


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing columns."""
    draw = random.Random(4)
    words = [draw.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60_000)]
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 3),
        (1, "The cat sat on the mat.", "en", "a", 3),
        (2, "the  cat\tsat on\nthe mat.", None, "a", 3),
        (3, None, "en", "b", None),
        (4, "", "en", None, 0),
        (5, " \n ", "de", "b", 3),
        (None, "The cat sat on the mat.", "en", "a", 3),
        (None, None, None, None, None),
        (6, " ".join(words), "en", "c", 9),
        (7, " ".join(words[:-1]), "en", "c", 9),
        (8, "one", "en", "c", 3),
        (9, "one two", "fr", "c", 7),
    ]
    return with_clashes(spark.createDataFrame(rows, DOCUMENTS))


def no_documents(spark):
    return with_clashes(spark.createDataFrame([], DOCUMENTS))
