import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    a, b = prose(1, 120), prose(2, 90)
    rows = [
        (0, a, "en", "s1", 1), (1, a, "en", "s1", 1), (1, a, "en", "s1", 1), (2, a.replace("the", "The", 1), "en", None, None),
        (3, None, "en", "s2", 0), (4, "", "en", "s2", 0), (5, " \t\n\x0b ", None, "s2", 0), (6, "12 34", "en", "", 5), (7, "one two", "en", "s2", 7),
        (None, b, "en", "s1", 3), (None, None, None, None, None), (8, prose(3, 30_000), "en", "s1", 9), (9, "x" * 3000, "xx", "s3", 9),
        (10, "#### " * 80, "en", "s1", 4), (11, "a b c d " * 40, "en", "s1", 4), (12, "même\nligne\nmême\n\n\nmême " + prose(4, 60), "fr", "s3", 4),
        (-5, "中文 文本 😀 é <|endoftext|> <s> ▁▁ x  y", "zh", "s3", 4), (13, "line\r\n" * 60 + prose(5, 200), "en", "s1", 4),
    ]
    return rows + [(100 + i, prose(1000 + i % 30, 60 + i % 7), "en" if i % 3 else "fr", f"s{i % 4}", i) for i in range(60)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as documents, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for c in ("size", "shard", "simhash", "component_id", "ids", "score", "lang_pred", "kept", "target", "n_words", "stage_row", "mix_row", "simhash_row", "bucket", "uid", "rank"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
