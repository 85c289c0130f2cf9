import pytest
from pyspark.sql import Row

LONG = " ".join(f"word{k % 700} the of" for k in range(3000))
TEXTS = {
    1: "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest tonight",
    2: "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest tonight",
    3: "another story: the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at noon\nand home",
    4: "",
    5: None,
    6: "  \t\n ",
    7: "word " * 60,
    8: "Word word WORD, ### $$$ |||\nsame line here\nsame line here\n",
    9: LONG,
    10: LONG + " end",
    11: "é à ü ß 日本語 text <|endoftext|> 12 345 don't  two  spaces\n \nend ",
    12: "one",
    13: "a stupid pathetic idiot wrote this trash, what a loser and a moron",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k0 int, t string, fp string, starts int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with the operators' own names."""
    rows = [(i, t, "en", "src0", len(t) if t else 0, 1, "t", "fp", 2) for i, t in TEXTS.items()]
    rows += [(13, TEXTS[13], "en", "src0", 0, 1, "t", "fp", 2), (None, TEXTS[1], None, None, None, None, None, None, None)]
    rows += [(14, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [Row(doc_id=i, quality=int(i not in (4, 7, 12)), toxic=int(i == 13), lang="x") for i in range(1, 14)]
    rows.append(Row(doc_id=None, quality=1, toxic=0, lang=None))
    rows.append(Row(doc_id=2, quality=None, toxic=None, lang=None))
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, lang string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
