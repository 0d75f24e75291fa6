import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, t string, key long, ids string, kept boolean, part int, size long, copies int, sig string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def hard_texts():
    """Texts that break things: null, empty, blank, tiny, copies, near copies, very long, odd characters."""
    long = words(30_000, 1)
    base = words(120, 2)
    near = base.split()
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "one"), (5, "one two"), (6, "One  two"), (7, "one two three"), (8, base), (9, base), (10, base.upper()), (11, " ".join(near)),
        (12, long), (13, long + " tail"), (14, "x" * 100_000), (15, "a b   c\u0085d é日本語 \U0001f600 ß İ <|endoftext|> '\"\\"), (16, "\x00\x01 nul"), (17, words(60, 3) + "\n" + words(60, 4)), (18, words(60, 5) + " " + words(60, 4)),
        (None, base), (None, None), (8, base), (19, words(80, 6)), (19, words(80, 7)),
    ]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 4}", None if t is None else len(t), 0.5, "r", "t", 1, "i", True, 3, 9, 2, "s") for i, t in hard_texts()]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def nothing(hard):
    return hard.limit(0)
