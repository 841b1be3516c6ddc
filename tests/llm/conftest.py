import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, token long, keep_id string"


def prose(rng: random.Random, n: int, syllables="ba ke lo mi tu ran sel vor".split()) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    base = prose(rng, 60)
    texts = [None, "", " ", "\n\n", "!?.", "word", "Two words", base, base, base.upper(), base.replace("ba", "ko", 1), prose(rng, 6000), "é ñ ü ß 漢字 \U0001f600", prose(rng, 40)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], None, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, "en", "a", 3, None, None, None), (None, None, None, None, None, None, None, None), (3, prose(rng, 30), "en", "c", 1, "x", 1, "y")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
