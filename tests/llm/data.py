"""Small tables with the awkward cases in them."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def documents() -> list[tuple]:
    """(doc_id, text, source, kept): an extra column clashes with names in use."""
    base = prose(1, 120)
    near = base.replace("alpha", "Alpha", 1) + " tail"
    rows = [
        (0, base, "a", "x"),
        (1, base, "a", "x"),
        (2, near, "b", "x"),
        (3, None, "b", None),
        (4, "", None, "x"),
        (5, " \n\t ", "a", "x"),
        (6, "one", "a", "x"),
        (7, "same words here " * 60, "a", "x"),
        (8, prose(2, 40) + "\n" + prose(3, 30) + "\n" + prose(2, 40), "c", "x"),
        (9, prose(4, 5000), "c", "x"),
        (10, "é" * 300 + " ñandú " + base[:200] + " 漢字 " + prose(5, 30), "c", "x"),
        (11, prose(6, 60) + base[100:400] + prose(7, 60), "d", "x"),
        (11, prose(8, 50), "d", "x"),
        (12, prose(9, 30), "d", "x"),
        (12, prose(9, 30), "d", "x"),
        (None, base, "d", "x"),
        (None, None, None, None),
    ]
    return rows


SCHEMA = "doc_id long, text string, source string, kept string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
