import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row_number string, place string, score string, shard string, copies string, id string, th string, rid string, n string, chunk string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names the operators use themselves."""

    def build(rows, partitions=3):
        full = [(*r, *[None] * (4 - len(r)), 0, *"abcdefghij") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions) if full else spark.createDataFrame([], DOC)

    return build


@pytest.fixture(scope="session")
def words():
    def say(seed, n, vocabulary=400):
        import random

        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return say


@pytest.fixture(scope="session")
def odd(words):
    """Rows with nulls, empty and blank texts, repeated rows, equal texts and one long text."""
    return [(None, "null id here", None, None), (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one", "en", "a"), (5, "two words", "de", "b"), (5, "two words", "de", "b"), (6, words(1, 4000), "en", "a"), (7, "two words", "fr", "b"), (8, "é ü " * 30, "fr", "c"), (9, words(2, 60), "en", "a"), (9, words(3, 60), "en", "a")]
