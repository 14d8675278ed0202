"""Pipeline stages keep and drop rows, not ids: rows that share a doc_id, or have none, are told by their texts."""

from collections import Counter

from plumeline.llm import decontaminate, near_dedup

WORDS = [" ".join(f"{name}{i}" for i in range(40)) for name in ("red", "blue", "green", "grey")]
COLUMNS = ("doc_id", "text", "lang", "source")


def left(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_one_row_of_each_component(table):
    red, blue, green, grey = WORDS
    rows = [(1, red), (1, blue), (1, blue), (2, blue), (5, green), (None, green), (None, green), (None, grey), (None, grey), (None, grey.upper() + " more"), (7, grey + " end"), (3, ""), (3, " \n"), (3, None), (None, ""), (None, "")]
    docs = table([(*r, "en", "s") for r in rows])
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    assert left(got) == Counter([(1, red), (1, blue), (5, green), (7, grey + " end"), (3, ""), (3, " \n"), (3, None), (None, ""), (None, "")])
    assert left(near_dedup.one_of_each(table([(None, t, "en", "s") for t in (red, red, blue)]))) == Counter([(None, red), (None, blue)])
    assert near_dedup.one_of_each(table([])).count() == 0


def test_only_rows_with_a_window_go(spark, table):
    red, blue, green, grey = WORDS
    rows = [(1, red), (1, blue), (1, blue), (None, red), (None, green), (None, None), (2, ""), (0, red), (0, grey)]
    docs = table([(*r, "en", "s") for r in rows])
    benchmark = spark.createDataFrame([("b", " ".join(red.split()[5:20]))], "item_id string, text string")
    got = decontaminate.clean_rows(docs, benchmark)
    assert got.columns == docs.columns
    assert left(got) == Counter([(1, blue), (1, blue), (None, green), (None, None), (2, ""), (0, grey)])
