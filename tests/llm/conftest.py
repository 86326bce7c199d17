import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="session")
def documents(spark):
    """The awkward cases: nulls in every column, empty, blank and very long texts, ties,
    repeated rows, and columns named like those that operators use."""
    import random

    rng = random.Random(5)

    def prose(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.2) for _ in range(n))

    base = [prose(60) for _ in range(30)]
    base[3] = base[2]
    base[5] = base[4].replace("alpha", "omega")
    texts = [*base, None, "", " \t\n\x0b\x0c\r ", prose(30_000), "wörd Ünï ½ 🙂 \x1c \x85 x", "one", "one two three"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, i, "k", [1]) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[6], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, size int, key long, kept string, lines array<int>",
    )


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
