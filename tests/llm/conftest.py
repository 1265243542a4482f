import random

import pytest

#: Columns that clash with names the operators use themselves.
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, fp string, lines string, removed int, part string, shard string, bucket string, place string, o string, u string, key string, label_id int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "a", "b", "c", 1, "d", "e", "f", "g", "h", "i", "j", 2) for i, t in rows]
        return spark.createDataFrame(full, FIELDS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, one id with two texts, equal texts, odd characters."""
    rng = random.Random(3)
    base = words(rng, 120)
    long = words(rng, 230_000, 5000)
    rows = [
        (1, base), (2, base), (3, base.replace("w", "v", 1)), (4, ""), (5, None), (6, " \n\t "), (7, "one"), (8, "Two words"), (9, long), (9, words(rng, 30)),
        (None, words(rng, 40)), (None, None), (10, "é Ünïcode 漢字 😀 " * 20), (11, "\x00\x1e.\x85"), (12, base), (12, base), (12, base), (13, "." * 5000), (14, "a" * 3_000_00),
    ]
    return rows + [(100 + k, words(rng, rng.randrange(5, 200))) for k in range(40)]
