import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, kind int, size double"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    long = "the quick brown fox jumps over the lazy dog again and again " * 2000
    texts = {
        1: "one two three four five six seven eight",
        2: "one two three four five six seven eight",
        3: "",
        4: None,
        5: long,
        6: " \t\n\x0b\x0c\r ",
        7: "été à la plage, naïve café — 日本語のテキスト 😀 done",
        8: "password = 'abcdef1234' and AKIA" + "A1B2C3D4" * 3 + " " + "0123456789abcdef" * 2,
        9: "x",
        10: "token=abc secret: supersecret token=token\"=abcdefgh",
        11: "a b\na b\n\n \na b\nc",
    }
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None, i, "r", i, 0.5) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, "no id here", None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None), (9, "another text with the id nine", "en", "s1", 3, "r", 1, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
