import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, c string"


def words(seed, n, kinds=400):
    r = random.Random(seed)
    return " ".join(f"w{int(kinds * r.random() ** 2)}" for _ in range(n))


def rows():
    """Nulls, empty and long texts, ties, copies, near copies and shared passages; two columns clash in name."""
    out, passage = [], words("p", 60, 4000)
    for i in range(40):
        out.append((i, words(i, 30 + i * 3), "en", f"s{i % 3}"))
    base = words("base", 200, 5000)
    out += [(100 + i, base, "en", "s0") for i in range(6)]
    for i in range(8):
        tokens = base.split(" ")
        tokens[20 * i] = f"changed{i}"
        out.append((200 + i, " ".join(tokens), "de", "s1"))
    out += [(300 + i, words(f"q{i}", 40, 9000) + "\n" + passage + "\n" + words(f"r{i}", 25, 9000), "en", None) for i in range(5)]
    out += [(400, None, None, None), (401, "", "en", "s0"), (402, "one two  THREE", "en", "s0"), (403, " \n\t\r ", "fr", "s2"), (404, "Ä Ö ü \u00a0x\u2003y\nÄ Ö ü \u00a0x\u2003y", "de", "s2")]
    out += [(500, words("long", 15_000, 50_000), "en", "s2"), (501, "a a a a a a a a a a a a a a a a a a a a a", "en", "s1")]
    out += [(600, words("rep", 50), "en", "s1")] * 3
    out += [(None, words("null", 30), "en", "s1"), (None, words("null", 30), "en", "s1")]
    return [(d, t, la, s, len(t) if t is not None else None, "x", None) for d, t, la, s in out]


@pytest.fixture(scope="session")
def mixed(spark):
    """The rows over several partitions, as a stored table would be read."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given():
    return rows()
