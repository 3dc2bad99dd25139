import pytest


@pytest.fixture(scope="session")
def prose():
    """A maker of deterministic pseudo prose."""
    import random

    parts = "an ber co de el fi gra hu in ja ker lo mi no or pa que ri sta tu".split()

    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(spark, prose):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows and clashing columns."""
    base = prose(1, 300).split()
    near = base[:150] + ["changed"] + base[151:]
    passage = prose(2, 60)
    rows = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, prose(3, 80) + " " + passage + " " + prose(4, 50)), (5, passage + "\n" + prose(5, 90)),
        (6, None), (7, ""), (8, "  \t\n"), (9, "one two three"), (10, "one two three"), (11, "One TWO three"), (12, "é à ü " * 30), (13, prose(6, 9000)), (14, prose(6, 9000).upper()),
        (None, " ".join(base)), (None, None), (15, passage), (15, passage), (15, prose(7, 70)), (16, "word " * 200), (17, prose(8, 40) + " " + "word " * 100), (18, "x" * 5000), (19, "x" * 5000 + " tail"), (-5, prose(9, 120)),
    ]
    data = [(i, t, ("en", None)[k % 2], ("a", "b", None, "")[k % 4], k, "c", k * 2, "r", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, bucket string, k long, score string, label long")
