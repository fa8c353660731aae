import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, and clashing names."""
    words = " ".join(f"word{k % 997} x{k}" for k in range(30000))
    base = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", None, "a", None), (4, None, "en", None, 0), (5, "", "en", "b", 0),
        (6, "  \n\t ", "en", "b", 0), (7, words, "en", "b", 9), (8, "One two", "en", "c", 7), (9, "one TWO", "en", "c", 7), (9, "one TWO", "en", "c", 7),
        (None, "no id at all here", "en", None, 3), (11, "card 4111 1111 1111 1111, mail a.b@c.example.com, 2024-01-05", "en", "c", 3), (12, "spam ham " * 40, "en", "a", 1),
        (13, "naïve café 漢字 🙂 <|endoftext|>  two  spaces\n\nend ", "fr", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def stored(spark, docs, tmp_path):
    """The documents as a folder of tables, and an empty one."""
    docs.repartition(3).write.parquet(str(tmp_path / "full" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    return str(tmp_path / "full"), str(tmp_path / "empty")
