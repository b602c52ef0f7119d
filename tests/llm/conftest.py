import random

import pytest


def rows(spark, *texts, first=0):
    """Documents with ascending ids and columns that clash with the operators' own names."""
    data = [(first + i, t, "en", f"s{i}", 1.5, "own", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, score double, rule string, secret_spans string"
    )


@pytest.fixture
def documents(spark):
    return lambda *texts, first=0: rows(spark, *texts, first=first)


@pytest.fixture
def rng():
    return random.Random(11)


#: Texts that every operator must take: null, empty, blank, one word, long, repeated, odd letters.
ODD_TEXTS = [None, "", " \n\t ", "word", "a b c d e f g h i j k l", "same text here now ok", "same text here now ok",
             "x" * 50_000, "é́ ß 日本 🙂 \x00   ", ("lorem ipsum " * 4_000).strip()]


@pytest.fixture
def odd_texts():
    return list(ODD_TEXTS)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder of their own and names it."""

    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
