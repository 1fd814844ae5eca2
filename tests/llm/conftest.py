import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

#: Rows every operator must take: nulls, empty, blank, repeated and tied rows, a long text.
ODD = [
    (1, None, None, None),
    (None, "token = abcdefgh12", "en", "s1"),
    (2, "", "en", "s1"),
    (3, " \t\n", None, "s1"),
    (4, "one two three four five six", "en", "s1"),
    (4, "one two three four five six", "en", "s1"),
    (5, "One two three four five six", "en", "s2"),
    (6, "word " * 60_000 + "end", "en", "s2"),
    (7, "日本語 тест émigré", "xx", "s3"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns whose names operators use inside."""
    table = spark.createDataFrame(ODD, SCHEMA)
    extra = {c: "x" for c in ("k1", "k2", "fp", "rep", "spans", "base", "digit", "part", "slot", "rate", "chances", "d", "n", "s", "t")}
    return table.selectExpr("*", "cast(length(text) as bigint) as n_chars", *[f"'{v}' as {k}" for k, v in extra.items()])


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")
