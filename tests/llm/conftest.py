import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples."""

    def made(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made


@pytest.fixture(scope="session")
def words():
    """n distinct pseudo-words by rule, from a seed."""
    import random

    def made(n, seed=0):
        rng = random.Random(seed)
        return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(1)) for _ in range(n)]

    return made
