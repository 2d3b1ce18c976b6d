import pytest
from pyspark.sql import functions as F

#: nulls in every column, empty and blank texts, one word, repeated rows, ties, a long text
LINES = "one two three four five six seven\nsecond line of the passage here\nthird line closes it\n"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, LINES + "the first document ends here", "en", "a", 1),
    (2, "an own start\n" + LINES + "and another end", "en", "a", 2),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n", "de", "b", 3),
    (6, "word", "de", "b", 4),
    (7, "Word", "de", "b", 4),
    (8, "mail me@example.org or +1 (555) 123-4567 from 10.0.0.1 with 4111 1111 1111 1111", "en", "c", 5),
    (8, "mail me@example.org or +1 (555) 123-4567 from 10.0.0.1 with 4111 1111 1111 1111", "en", "c", 5),
    (None, LINES + "a document without an id", None, None, None),
    (9, "12 34 !? --", None, "c", 9),
    (10, LONG, "fr", "c", 10),
    (11, LONG + " tail", "fr", "c", 11),
    (12, "日本語 ñandú ▁ été \U0001f600", "es", "c", 12),
    (13, LINES + "the first document ends here", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHES = ("id", "batch", "bucket", "reply", "digest", "node", "label", "gram", "pos", "a", "b", "kept", "spans", "ids", "score", "keep_id", "h", "n",
           "__id", "__n_lines", "__n_removed", "__covered", "__hit_id", "__hit_hash", "__leak", "__rn")


@pytest.fixture(scope="session")
def odd(spark):
    """Small documents with every odd case, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3, F.rand(1))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
