import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_data import prose  # noqa: E402

EXTRA = "id string, key string, score double, n int, component long, rank int, slot long, bin long, label string, toxic int, v int, path string"


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like those the operators make."""
    base = prose(1, 120)
    rows = [
        (0, base, "en", "s0", len(base)),
        (1, base, "en", "s0", len(base)),
        (2, base.replace("river", "rivers", 1), "en", "s1", len(base)),
        (3, None, "en", "s0", None),
        (4, "", None, None, 0),
        (5, "one", "de", "s1", 3),
        (6, "one  two", "de", "", 8),
        (7, "ONE\ttwo\n", "de", "s2", 8),
        (8, prose(2, 30_000), "fr", "s2", None),
        (9, "x" * 200_000, "fr", "s2", 200_000),
        (10, "12345 !!! ...", "fr", "s2", 13),
        (11, "Ünïcödé ñandú \U0001f600 straße", None, "s2", 24),
        (11, "Ünïcödé ñandú \U0001f600 straße", None, "s2", 24),
        (None, "a row without an id", "en", None, 19),
        (None, None, None, None, None),
    ]
    extra = (None, "k", 0.5, 1, 7, 2, 3, 4, "z", 1, 9, "p")
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def none(messy):
    return messy.filter("doc_id < -1")
