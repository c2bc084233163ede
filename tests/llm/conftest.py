import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.fixture(scope="session")
def texts():
    """All kinds of texts: plain, empty, null, blank, repeated, accented, very long, with special strings."""
    long = " ".join(f"wörd{i % 977} the idiot{i % 13}" for i in range(20_000))
    return ["The cat sat.\nOn the mat, it's fine.", "", None, "   \n\t ", "The cat sat.\nOn the mat, it's fine.", "Éà ü 中文 ✓ 12.5% naïve", long, "<|endoftext|>x <|endoftext|>", "a", "x" * 5000]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k if k != 3 else None, t, "en", "src", 7, "clash", 1, "y") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, cls int, bucket string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
