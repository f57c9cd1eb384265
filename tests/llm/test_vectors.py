"""Nearest neighbours: recall against brute force, exact scores, and the cases the search defines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, _cell string, rank int"
RNG = np.random.default_rng(11)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, count=20):
    """Sorted (score, id) of all other rows, for each query row."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    return {n: (q, sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(good) if m != n)[:count]) for n, (q, v) in enumerate(good) if q % 20 == 0}


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def clustered(n, d):
    centres = RNG.normal(size=(12, d))
    return [(i, centres[i % 12] + 0.3 * RNG.normal(size=d)) for i in range(n)]


@pytest.mark.parametrize("rows", [clustered(3000, 16), [(i, RNG.normal(size=24)) for i in range(2000)]], ids=["clusters", "no structure"])
def test_recall_and_scores(spark, rows):
    got, want = lists(vectors.search_report(frame(spark, rows))), brute(rows)
    hits = 0
    for q, best in want.values():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        by_id = dict(rows)
        for _, x, score in got[q]:
            assert x != q
            assert score == pytest.approx(float((np.float32(by_id[q]).astype(float) * np.float32(by_id[x]).astype(float)).sum()), abs=1e-12)
        assert [(-s, x) for _, x, s in got[q]] == sorted((-s, x) for _, x, s in got[q])
        hits += len({x for _, x, _ in got[q]} & {x for _, x in best})
    assert hits >= 0.9 * 20 * len(want)


def test_clusters_need_a_small_share():
    found = np.array([v for _, v in clustered(4000, 16)])
    books = tuple(vectors.centroids(h, 8) for h in vectors._halves(found))
    assert vectors.share_needed(found, books, 20) < 0.35


def test_odd_rows(spark):
    base = [(i, RNG.normal(size=5).round(1)) for i in range(1, 70)]
    rows = base + [(100, base[0][1]), (120, base[0][1]), (140, None), (160, []), (180, [0.0] * 5), (200, [1, None, 1, 1, 1]), (220, [1, np.nan, 1, 1, 1]), (240, [np.inf, 1, 1, 1, 1])]
    rows += [(None, base[3][1]), (260, [1.0, 2.0]), (300, base[7][1]), (300, base[7][1]), (300, base[8][1]), (-20, base[9][1])]
    want = brute([r for r in rows if r[0] != 260])
    got = vectors.neighbours(frame(spark, rows), F.col("_id") % 20 == 0, share=1.0).collect()
    found = sorted((r.query_id, r["rank"], round(-r.score, 9), r.vec_id) for r in got)
    expected = sorted((q, k, round(s, 9), x) for q, best in want.values() for k, (s, x) in enumerate(best, 1))
    assert found == expected


def test_one_vector_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 3)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    same = RNG.normal(size=6).round(2)
    rows = [(i, same) for i in range(0, 400)] + [(i, RNG.normal(size=6).round(2)) for i in range(400, 520)]
    got = vectors.neighbours(frame(spark, rows), F.col("_id") % 20 == 0, share=1.0).collect()
    found = sorted((r.query_id, r["rank"], round(-r.score, 9), r.vec_id) for r in got)
    assert found == sorted((q, k, round(s, 9), x) for q, best in brute(rows).values() for k, (s, x) in enumerate(best, 1))


def test_few_and_no_rows(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert lists(vectors.search_report(frame(spark, rows))) == {0: [(1, 1, 2.0), (2, 2, -1.0)]}
    assert vectors.search_report(frame(spark, [])).collect() == []
    assert vectors.search_report(frame(spark, [(20, [1.0, 2.0])])).collect() == []


def test_the_walk_passes_cells_in_order():
    books = (RNG.normal(size=(5, 3)), RNG.normal(size=(7, 4)))  # the first half of an odd vector is the shorter one
    query, sizes = RNG.normal(size=7), RNG.integers(0, 4, 35)
    sums = {a * 7 + b: query[:3] @ books[0][a] + query[3:] @ books[1][b] for a in range(5) for b in range(7)}
    order = vectors.walk(query, books, sizes, np.inf)
    assert order == sorted((c for c in sums if sizes[c]), key=lambda c: -sums[c])
    some = vectors.walk(query, books, sizes, 9)
    assert some == order[: len(some)] and sizes[some].sum() >= 9 > sizes[some[:-1]].sum()
