"""Documents with every awkward case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

import pytest

WORDS = "the of and thing ering onth ation able stone river cloud paper engine light morning garden window bridge market".split()


def prose(rng, n):
    out, line = [], []
    for k in range(n):
        line.append(rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choice("aeioubcdfgh") for _ in range(6)))
        if rng.random() < 0.1:
            line[-1] += "."
        if len(line) > 12:
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)])


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, "One"), (104, "Two words"), (105, prose(rng, 12_000)), (106, rows[5][1]), (107, rows[5][1] + " extra"), (None, rows[7][1]), (5, rows[5][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With columns whose names operators use themselves."""
    rows = [(i, t, "en", "src1", len(t or ""), "x", 7, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, length int, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
