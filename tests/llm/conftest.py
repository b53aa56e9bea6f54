import pytest

LONG = "alpha beta gamma delta epsilon " * 20_000

#: Rows that every operator must take: nulls, blanks, one word, very long, ties, repeats.
AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "s1"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "s1"),
    (3, None, "en", "s2"),
    (4, "", None, "s2"),
    (5, " \t\n ", "fr", None),
    (6, "word", "fr", None),
    (7, LONG, "de", "s3"),
    (8, "12345 67890 !!! ###", "de", "s3"),
    (None, "a row without an id", "en", "s1"),
    (9, "naïve café Ünïcode 🙂 текст 日本語", None, "s1"),
]


def documents(spark, rows=AWKWARD, clash=()):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in clash:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


@pytest.fixture(scope="session")
def awkward(spark):
    return documents(spark)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
