import random

import numpy as np
import pytest

from ledgerspark.llm import ranker

N = len(ranker.FEATURES)


def vector(at: int, value: float) -> list[float]:
    x = [0.0] * N
    x[at] = value
    return x


@pytest.mark.parametrize(("good", "bad", "pairs", "made"), [(7, 3, 5, 7), (3, 7, 5, 7), (7, 3, 20, 21), (4, 1, 99, 4)])
def test_every_labelled_row_is_in_a_pair(spark, good, bad, pairs, made):
    rows = [(i, vector(1, i + 1.0), 1) for i in range(good)] + [(100 + i, vector(2, i + 1.0), 0) for i in range(bad)]
    learnt = spark.createDataFrame(rows, "_id long, _x array<double>, _label int")
    diffs, n = ranker.pair_differences(learnt, {1: good, 0: bad}, np.zeros(2 * N), np.ones(2 * N), pairs)
    got = [(r["_d"][1], -r["_d"][2]) for r in diffs.collect()]
    assert n == len(got) == len(set(got)) == made
    assert {a for a, _ in got} == {i + 1.0 for i in range(good)} and {b for _, b in got} == {i + 1.0 for i in range(bad)}


def test_value_of_a_rank_is_exact(spark):
    r = random.Random(4)
    values = [r.choice([0.25, r.random(), 1e-12 * r.random(), -1e6]) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 150, 349, 500, 700):
        assert ranker.at_rank(df, "v", k) == sorted(values)[k - 1]


def test_rows_beyond_the_former_sample_are_learnt(spark):
    """4,000 rows of a label were the most before: the scaling has all of them."""
    rows = spark.range(9000).selectExpr("id _id", f"transform(sequence(0, {N - 1}), i -> if(i = 1, cast(id as double), 0D)) _x")
    assert ranker.scaling(rows)[0][1] == 4499.5
