"""Small tables for the corpus operators."""

import pytest

#: Nulls, empty and white-space texts, ties, repeated rows, other scripts and a very long text.
ODD = [
    (1, "The cat sat on the mat. The cat ate.", "en", "src1"),
    (2, "the cat sat on the mat. the cat ate.", "en", "src1"),
    (2, "the cat sat on the mat. the cat ate.", "en", "src1"),
    (3, "", "en", None),
    (4, None, None, "src2"),
    (5, " \n\t ", "fr", "src2"),
    (6, "Été à Paris, ΑΣ ΣΑΣ ﬁne Straße <|endoftext|> 日本語 🙂", "fr", "src3"),
    (None, "no id here but words", "en", "src1"),
    (None, None, None, None),
    (7, "word " * 30_000 + "end", "de", "src0"),
    (8, "x" * 50_000, "de", "src0"),
    (9, "a b", "de", "other"),
    (9223372036854775807, "largest id of all", "en", "src5"),
    (-3, "a negative id", "en", "src5"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows of documents with extra columns whose names clash with those that operators make."""
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(ODD, schema)
    return df.selectExpr("*", "length(text) as n_chars", "'x' as score", "'y' as shard", "'z' as fp", "1 as __key", "2 as hash")


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """A data folder with the odd documents, and one with empty tables."""
    top = tmp_path_factory.mktemp("data")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 1, 0), (6, 0, 1), (9, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the cat sat on the mat the cat"), (1, "the cat sat on the mat the cat"), (2, ""), (3, None), (None, "word " * 40)], "item_id long, text string")
    pages = spark.createDataFrame(
        [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", ""), (None, "u", "alone"), (9, "u", "z" * 700_000), (9007199254740993, "u", "big id")],
        "page_id long, url string, html string",
    ).selectExpr("*", "'x' as digest", "1 as keeper")
    for kind, cut in (("odd", None), ("empty", 0)):
        for name, df in (("documents", odd), ("labels", labels), ("benchmark", bench), ("pages", pages)):
            (df if cut is None else df.limit(0)).write.parquet(f"{top}/{kind}/{name}.parquet")
    return str(top)
