import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(120))
    near = long.replace("w7 ", "x7 ")
    texts = [long, near, long, "", None, "one two three", "One Two three", " \t\n", "passage " * 5 + long + " tail of its own", "é ß 漢字 " * 30, "same words again " * 80, long]
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), rows[0]]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
