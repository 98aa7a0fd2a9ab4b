import random

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, copies and near copies, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))) for _ in range(60)]
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(60, 90):  # near copies: one or two words changed
        t = base[i % 20].split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t), "en", None))
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, " \n\t", "en", "s1"), (93, "One two", "en", "s2"), (94, "one  TWO", "de", "s2")]
    rows += [(95, base[0], "en", "s0"), (95, base[0], "en", "s0"), (None, base[1], "en", "s0"), (96, "x" * 300_000 + " " + base[2], None, "s3"), (97, "é 日本 " * 40, "fr", "s3")]
    made = spark.createDataFrame([(*r, 7, "k", 0.5, 3) for r in rows], "doc_id long, text string, lang string, source string, n long, key string, score double, size int")
    return made.cache()
