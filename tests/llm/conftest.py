import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long, score double, lang_pred string, fp long, key string, passes int, h long"


def words(rng, n, kind="en"):
    parts = {"en": ["th", "er", "ing", "on", "re", "wh", "and"], "de": ["sch", "ung", "ein", "ver", "keit", "ü", "ß"]}[kind]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Ids, nulls in every column, empty, blank and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    out = []
    for k in range(60):
        kind = "de" if k % 3 == 0 else "en"
        out.append((k, words(rng, rng.randint(3, 80), kind).capitalize() + ".", kind, f"s{k % 4}"))
    long = words(rng, 9000) + "."
    out += [(100, long, "en", "s0"), (101, long + " extra", "en", "s0"), (102, long, None, None)]
    out += [(110 + k, out[1][1], "en", "s1") for k in range(5)]
    out += [(120, None, "en", "s1"), (121, "", "de", "s1"), (122, " \n\t ", "en", "s2"), (123, "12345 !!!", "en", None), (124, "one", "en", "s2"), (125, "é ☃ 😀", None, "s3")]
    out += [(None, None, None, None), (None, out[2][1], "en", "s1"), (130, out[5][1], "de", "s3"), (130, out[5][1], "de", "s3"), (131, "  a  b   c ", "en", "s\U00010000"), (132, "x", "en", "s￿")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, lang, s, len(t or ""), 7, None, -1, 0.5, "zz", 1, None, 3, None) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
