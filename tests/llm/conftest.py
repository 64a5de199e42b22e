import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def edge_rows():
    """Ids and texts with nulls, empty and long texts, copies, near copies and ties."""
    rng = random.Random(7)
    base, other = prose(rng, 120), prose(rng, 90)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (3, 50, 110)]
    passage = prose(rng, 40)
    texts = [base, base, *near, other, "", None, " \n\t ", "one", "two words", other.upper(), prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30),
             prose(rng, 20) + "\n" + passage, "x" * 700, passage[:99], passage[:100], prose(rng, 3000), "naïve café déjà vu " * 20, "\U0001f600" * 60, base + " tail"]
    rows = [(i + 1, t, [None, "en", "de"][i % 3], [None, "s1", "s2"][i % 3], None, "clash", 5) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "s1", 3, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
