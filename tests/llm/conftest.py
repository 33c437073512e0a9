import pytest

LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today."),
    (3, None),
    (4, ""),
    (5, "   \n\t  "),
    (None, "a text without an id"),
    (6, LONG),
    (7, "Ünïcode é ß 漢字   and \x85 marks,  two blanks"),
    (8, "one"),
    (-9, "you 1d10t! call +1 (017) 555-7713 or mail a.b@c.de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, None if n % 3 == 0 else f"s{n % 2}", "x", n, "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, position string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
