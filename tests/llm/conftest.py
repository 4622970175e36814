import pytest

from quantgrid.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows and a very long text.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 67),
    (1, "The quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 67),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t\n ", "", "", 6),
    (None, "The quick brown fox jumps over the lazy dog and runs away from here", None, "b", 67),
    (None, None, None, None, None),
    (5, "x" * 60_000, "en", "a", 60_000),
    (6, "word " * 20_000, "en", "a", 100_000),
    (7, "é漢🙂 <|endoftext|> a  b\n\n \nc", "fr", "a", 25),
    (8, "7 " * 3_000 + "1.2.3.4 " * 300, "en", "a", 1),
    (9, "one two", "en", "a", 7),
]


@pytest.fixture(scope="session")
def odd(spark):
    return ship(spark).createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def cluttered(odd):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["_id", "_text", "id", "node", "bucket", "spans", "base", "key", "score", "pid", "rank", "length", "kept", "grp", "n_lines", "text_"]
    return odd.select("*", *[F.lit("clash").alias(c) for c in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def compare(odd, cluttered, empty):
    """Runs an operator on the odd table; extra columns must change nothing, and an empty table give nothing."""

    def run(operator):
        got = operator(odd)
        found = rows(got)
        assert rows(operator(cluttered).select(*got.columns)) == found
        assert rows(operator(empty)) == []
        return [r.asDict() for r in got.collect()]

    return run
