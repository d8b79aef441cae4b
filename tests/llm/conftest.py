"""A small corpus with every awkward row: nulls, empty and long texts, ties, copies, clashing columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, node bigint, place int"


def corpus_rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(90)
    texts = [prose(rng.randint(1, 160)) for _ in range(40)]
    texts += [prose(30) + " " + passage + "\n" + prose(20) for _ in range(4)]
    base = prose(120)
    texts += [base, base, base + " tail", base.upper()]
    texts += ["", None, " \n\t ", "x", "x", "a\x0bb\x0cc\r\nd", "word " * 300, "ß" * 700, prose(4000) + " " + passage]
    rows = [(i * 3, t, ["en", "de", None][i % 3], "src0", None if t is None else len(t), "clash", 7, 1) for i, t in enumerate(texts)]
    return rows + [(None, base, "en", None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[3], (9, "other text of one id", "en", "s", 1, "r", 1, 1)]


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
