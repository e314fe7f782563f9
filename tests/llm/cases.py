"""Small documents with every edge case, and documents of the driver's smallest table."""

import random

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def near(seed: int, n: int, changes: int, to: int) -> str:
    words, rng = text(seed, n).split(" "), random.Random(to)
    for _ in range(changes):
        words[rng.randrange(n)] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def documents(spark, extra: str = "chunk"):
    """doc_id, text and a column whose name an operator uses itself."""
    rows = [(1, text(1, 80)), (2, text(1, 80)), (3, text(1, 80).upper()), (4, near(1, 80, 3, 4)), (5, near(1, 80, 5, 5)), (6, near(1, 80, 20, 6))]
    rows += [(10, None), (11, ""), (12, " \t\n "), (13, "one"), (14, "ONE"), (15, "one two"), (16, "one two three"), (17, "one two three four")]
    rows += [(20, text(7, 30_000)), (21, text(7, 30_000) + " end"), (22, "x" * 200_000), (30, text(3, 50)), (30, text(3, 50)), (None, text(3, 50)), (None, text(9, 20))]
    rows += [(40 + i, near(2, 120, i % 7, i)) for i in range(60)]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], f"doc_id long, text string, {extra} string")
