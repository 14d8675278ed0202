"""Of labelled texts only near copies are thinned, and to one of each label."""

from plumeline.llm import toxicity


def test_unlike_texts_and_both_labels_stay(spark, table):
    passage = [f"word{i}" for i in range(200)]
    texts = [" ".join(passage), " ".join([*passage[:-1], "end"]), " ".join(passage)]
    # texts that have one word pair in common each with the next, and are otherwise unlike
    texts += [f"shared pair {' '.join(f'w{k}x{i}' for i in range(3))}" for k in range(60)]
    docs = table([(i, t, "en", "s") for i, t in enumerate(texts)])
    sample = spark.createDataFrame([(i, int(i == 2)) for i in range(len(texts))], "doc_id long, label int")
    assert {r.doc_id for r in toxicity.thinned(docs, sample).collect()} == {0, 2, *range(3, 63)}
