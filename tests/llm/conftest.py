import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]


@pytest.fixture(scope="session")
def spark():
    from agestack.session import local_session

    return local_session("llm tests", 4)


@pytest.fixture
def docs(spark):
    """Makes documents from ``(doc_id, text[, source])`` rows, with clashing extra columns."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2.0, "y") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n double, at string")

    return make
