"""Held-out accuracy on the labels of the test tables."""

import os

import pytest

from plumeline.llm import quality, toxicity

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("query, column, recall, alarms", [(toxicity.op5_toxicity, "toxic", 0.9, 0.01), (quality.op4_quality, "quality", 0.97, 0.03)])
def test_held_out(spark, query, column, recall, alarms):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in query(spark, DATA).where("held_out").collect() if labels.get(r.doc_id) is not None]
    yes, no = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert len(yes) > 50 and sum(yes) >= recall * len(yes)
    assert sum(no) <= alarms * len(no)
