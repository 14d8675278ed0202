import random

import pytest

#: Columns whose names operators might use for themselves.
CLASHING = ("digest", "h", "d", "t", "size", "hash", "key", "words", "rid", "cid", "rank", "score", "canon", "bucket", "spans")


@pytest.fixture(scope="session")
def edge_docs():
    """Rows (doc_id, text, lang, source): nulls everywhere, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta.", "eta", "theta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, text(rng.randrange(1, 60)), "en", f"s{i % 3}") for i in range(20)]
    rows += [(30, base, "en", "s0"), (31, base, "en", "s1"), (32, " ".join(near), "fr", None), (33, base[:300] + " tail " + text(10), None, "s2"), (34, "X" * 49 + base[100:149], "en", "s0"), (35, base[100:150], "en", "s0")]
    rows += [(40, None, None, None), (41, "", "en", "s0"), (42, " \n\t ", "en", "s0"), (43, None, "en", "s1"), (44, "word", "en", "s1"), (45, "word", "en", "s1"), (46, "long " * 30_000, "en", "s0"), (47, "y" * 100_000, "en", "s0")]
    rows += [(50, base, "en", "s0"), (50, base, "en", "s0"), (51, "same id, other text", "en", "s0"), (51, "same id, another text", "en", "s0"), (None, base, "en", "s0"), (None, "nobody's text", None, None), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, clash=True):
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        if clash:
            for c in CLASHING:
                frame = frame.selectExpr("*", f"'clash' AS {c}")
        return frame

    return make
