"""The share of bad documents is that of all labels, not of the drawn ones."""

import random

from ledgerspark.llm import ranker


def test_both_labels_exceed_the_sample(spark):
    r = random.Random(3)
    rows = [(i, " ".join("word" * r.randrange(1, 4) for _ in range(r.randrange(20, 60)))) for i in range(1200)]
    labels = [(i, int(i % 10 > 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ranker.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int"), sample=60).collect()
    assert len(got) == 1200
    assert 0.02 < sum(x.predicted == 0 for x in got) / len(got) < 0.25  # a tenth is bad; texts don't tell which
