import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, raw binary, kept boolean, score double, "
    "size int, node long, content string, component long, target double, seen long, number int"
)
WORDS = "amber birch cedar dune ember fjord grove heath islet jetty knoll ledge marsh oasis plain ridge spire vale".split()


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(id, text, lang, source): nulls, empty texts, a very long one, ties, repeats, odd white space and characters."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    lines = "\n".join(prose(40 + k, 12) for k in range(12))
    return [
        (1, base, "en", "a"),
        (2, base.replace(" ", "\t", 5) + "  ", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "de", None),
        (5, " \n\t\x0b", None, "b"),
        (6, prose(2, 20_000), "en", "b"),
        (7, near, "en", "c"),
        (8, "short text", "en", "c"),
        (8, "short text", "en", "c"),
        (9, "Short TEXT", None, None),
        (10, "three words here ▁ ▁x \U0001f600 ﷐", "fr", "a"),
        (11, lines, "en", "b"),
        (12, prose(70, 30) + "\n" + "\n".join(lines.split("\n")[3:9]) + "\n\n" + prose(71, 30), "en", "b"),
        (13, lines.replace("\n", " \n\n"), "en", None),
        (14, "same " * 80, "en", "a"),
        (15, "x" * 3_000, "en", "a"),
        (None, "a row without id " + prose(5, 60), "en", "a"),
        (None, None, None, None),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators use themselves."""
    rows = [(i, t, la, s, 0, "k", b"r", True, 0.5, 7, 1, "c", 2, 1.5, 3, 4) for i, t, la, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def spark_rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="session")
def collected():
    return spark_rows
