import random
import zlib

import pytest

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, id string, score string, label string, fp string"


def words(seed, n, stems=("an", "be", "co", "du", "el", "fi", "go", "hu")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Ids and texts: null and empty ones, no letters, one word, very long, copies, repeated rows, a null id."""
    base = words(1, 120)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "123 !! 456"), (5, "One"), (6, base), (7, base),
            (8, base), (8, base), (9, base + " extra"), (10, words(2, 60_000)), (11, "ÄÖ é ñ\u00a0\u2003x 日本語 🙂 e\u0301"),
            (12, "x" * 5_000), (None, words(3, 50)), (None, None), (13, "two words"), (14, "Two\tWords"),
            (15, words(4, 30).upper()), (2**60 + 1, words(5, 40))]


@pytest.fixture
def frame(spark):
    """Documents with columns whose names the operators use themselves."""
    def make(rows, lang="en"):
        return spark.createDataFrame(
            [(t, i, lang if not isinstance(lang, dict) else lang.get(i), None, 1, "x", "y", "z", "w") for i, t in rows],
            SCHEMA).repartition(3)
    return make


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts
