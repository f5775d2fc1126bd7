import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


@pytest.fixture(scope="session")
def stock():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(stock):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(2)
    base = words(rng, 60, stock)
    near = base.split()
    near[30] = "changed"
    long = words(rng, 30_000, stock)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \n\t ", None, "b", 5), (4, "12 34 --", "en", None, 8),
        (5, base, "en", "a", 1), (6, base, "fr", "b", 1), (7, " ".join(near), None, None, None), (8, long, "en", "a", 1),
        (None, base, "en", "a", 1), (None, None, None, None, None), (9, "Short one.", "en", "c", 10), (9, "Short one.", "en", "c", 10),
        (10, base.upper() + "\n\n<|endoftext|> x", "en", "c", 10),
    ]
    return rows + [(100 + i, words(rng, rng.randint(1, 90), stock) + ".\n" + words(rng, 12, stock), ("en", "fr")[i % 2], f"s{i % 4}", 1) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns with the names that operators give to results."""
    from pyspark.sql import functions as F

    names = "keep_id group_size kept text_sha256 size source_size target taken lang_pred score n_tokens ids decoded n_known sentence_ids licenses train_tokens base_score clean_text removed_spans component_id n_shingles h sid comp rank start end".split()
    return odd.select("*", *[F.lit("x").alias(n) for n in names])
