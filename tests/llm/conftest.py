"""Documents with everything that may go wrong: NULLs, blanks, copies, ties, long texts, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, block long, kept boolean"
SYLLABLES = "ka ro mi ten sul va lo pri es ond ur bel gat no fi".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows, **more):
    """(doc_id, text) rows as documents with columns whose names operators use themselves."""
    data = [(i, t, more.get("lang", "en"), f"src{k}", len(t) if t else 0, 0.5, 7, True) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def odd():
    """(doc_id, text) rows."""
    rng = random.Random(5)
    passage, other = prose(rng, 70), prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(10, 60)]
    rows += [(i, rows[3][1]) for i in range(100, 106)]  # exact copies
    rows += [(200 + i, " ".join(w if j != 7 * i else "new" + str(i) for j, w in enumerate(rows[5][1].split()))) for i in range(1, 6)]  # near copies
    rows += [(300 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)) for i in range(4)]  # a shared passage
    rows += [(310, other + " " + passage[:200]), (311, prose(rng, 5) + other)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "!!! ..."), (404, "x"), (405, "é" * 60), (406, "日本語 テスト")]
    rows += [(500, "same row"), (500, "same row"), (501, "a\x00b ퟿ c"), (None, rows[0][1]), (None, None)]
    rows += [(600, prose(rng, 4000)), (601, "w" * 30_000), (-7, rows[8][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def odd_docs(spark, odd):
    return frame(spark, odd).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
