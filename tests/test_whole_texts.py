"""Queries read whole texts."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from plumeline.operators.dedupe import dedupe
from plumeline.plans import binding as B
from plumeline.plans.queries import QUERIES

LONG = "A title of a few words that goes on for longer than sixty characters, and then " + " ".join(f"Word{i}" for i in range(3000)) + "  last\tﬁn word7"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of test tables with a few long documents; 1 and 13 have one text and are equally rich."""
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, LONG, "en", "src1"), (13, LONG, "en", "src2"), (7, LONG, "en", "src3"), (2, LONG + " <b> & more", "fr", "src0"), (3, "short", "en", "src1"), (4, None, "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path, rows


def test_terms_of_whole_texts(spark, tables):
    path, rows = tables
    want = set()
    for doc_id, text, *_ in rows:
        terms = list(dict.fromkeys(unicodedata.normalize("NFKC", text or "").lower().split()))
        want.add((doc_id, len(terms), sha("|".join(terms))))
    assert {tuple(r) for r in QUERIES["search_terms"](spark, path).collect()} == want
    assert max(n for _, n, _ in want) > 3000


def test_summaries_are_whole_texts(spark, tables):
    path, rows = tables
    whole = {text or "" for _, text, *_ in rows}
    deduped = {(r.item_ord, r.merged): r.summary for r in QUERIES["dedupe"](spark, path).collect()}
    assert deduped == {(1, 3): sha(LONG), (2, 1): sha(LONG + " <b> & more"), (3, 1): sha("short"), (4, 1): sha("")}
    for name in ("public_articles", "article_view"):
        assert {sha(t) for t in whole if t} <= {r.summary for r in QUERIES[name](spark, path).collect()}
    assert len({r.html for r in QUERIES["render_card_html"](spark, path).collect()}) == 4


def test_longer_of_two_long_summaries_wins(spark, tables):
    """Of equally rich copies the later one is longer by a few characters at its end."""
    path, _ = tables
    articles = B.articles(spark, path).where("item_ord in (1, 13)").withColumn("summary", F.concat("summary", F.repeat(F.lit("x"), F.col("item_ord").cast("int"))))
    (row,) = dedupe(articles).collect()
    assert (row.merged, row.feed_id, row.summary) == (2, "src2", LONG + "x" * 13)
