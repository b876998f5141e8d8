from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import ODD, SCHEMA, frame  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, repeated and very long texts; a null id and a repeated row."""
    texts = [*ODD, "same text here"]
    return frame(spark, texts, [*range(len(ODD) - 1), None, 7])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
