import pytest

#: Null, empty, blank, short, repeated, punctuated and very long texts; doc 7 and 7 again are one row twice.
TEXTS = {
    1: None, 2: "", 3: " \t\n\x0b ", 4: "one", 5: "a b c d e f g h i j k l", 6: "a b c d e f g h i j k l", 7: "Repeat me. " * 30, 8: "word " * 30_000, 9: "Grüße aus Köln, <|endoftext|> ok",
    10: "\x00 \x1c x\xa0\n y 字字 é #*$%&|<>", 11: "line one\nline one\n\nline two",
}


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", i) for i, t in TEXTS.items()]
    return [*rows, rows[6]]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Documents with columns whose names the operators use inside."""
    docs = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "fp", "host", "size", "at", "gram", "m", "part", "key", "n", "words", "taken", "block"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
