import os

import pytest


@pytest.fixture(autouse=True, scope="session")
def package_on_workers(spark):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


@pytest.fixture(scope="session")
def byte_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes a documents table with clashing extra columns."""

    def make(rows):
        full = [(*r, "en", "s", -1, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_words long, repeats string, _row string, component_id string").repartition(3)

    return make
