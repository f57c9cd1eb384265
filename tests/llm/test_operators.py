"""Edge cases that every operator defines, and brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerspark.llm import exact, language, mixing, near, quality_rules, queries, ranker, templates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _node long, score double"
R = random.Random(5)
EN = "the of and a to in is that it was for on are as with they be at one have this".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()


def prose(words, n):
    return " ".join(R.choice(words) + R.choice(["", "", "ing", "ung", "s"]) for _ in range(n)).capitalize() + "."


def make_rows():
    base = [prose(EN, 120) for _ in range(12)] + [prose(DE, 120) for _ in range(12)]
    rows = [(i, t, "en" if i < 12 else "de", f"s{i % 3}") for i, t in enumerate(base)]
    near_copy = base[0].split()
    near_copy[60] = "changed"
    rows += [(40, base[0].upper(), "en", "s0"), (41, " ".join(near_copy), "en", None), (42, base[1], None, "s1"), (42, base[1], None, "s1"), (43, base[1] + " É", "en", "s1")]
    rows += [(None, base[2], "en", "s0"), (None, None, None, None), (44, None, "en", "s2"), (45, "", "en", "s2"), (46, " \n\t", "de", "s2"), (47, "one two three", "en", "s1"), (48, "ONE two  three", "en", "s1")]
    rows += [(49, "word " * 30_000, "en", "s2"), (50, "x" * 100_000, "en", "s2"), (51, "1 2 3 + 4", "en", "s2"), (52, "été " * 5, "fr", "é")]
    return [(i, t, lang, s, 1, True, 7, 0.5) for i, t, lang, s in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exact_groups(docs):
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    want = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert rows_of(exact.exact_groups(docs)) == sorted(want, key=str)
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, [r.doc_id for r in left.collect()])) == sorted(str(max((i for i in ids if i is not None), default=None)) for ids in groups.values())


def sets_of(t):
    w = words(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_groups(docs):
    sets = [sets_of(r[1]) for r in ROWS]
    parent = list(range(len(ROWS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ROWS)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, r in enumerate(ROWS):
        members[root(i)].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    want = [(r[0], len(sets[i]), least[root(i)], r[0] == least[root(i)]) for i, r in enumerate(ROWS)]
    assert rows_of(near.near_report(docs)) == sorted(want, key=str)
    left = near.without_near_copies(docs)
    assert left.columns == docs.columns
    empty = sum(not s for s in sets)
    assert left.count() == empty + len({root(i) for i, s in enumerate(sets) if s})


def test_hidden_links_in_blocks(spark):
    """Chains of versions, each close to its neighbours only: stars alone don't find them."""
    rows, r = [], random.Random(2)
    for g in range(3):
        text = [f"w{g}x{r.randrange(10**6)}" for _ in range(150)]
        for v in range(40):
            rows.append((g * 100 + v, " ".join(text)))
            text[r.randrange(150)] = f"v{r.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in near.near_report(df).collect()} == {(i, i // 100 * 100) for i, _ in rows}


def test_stars_join_long_chains(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (500, 501), (501, 500), (7, 7)], "_u long, _v long")
    got = {(r._v, r._u) for r in near.components(links).collect()}
    assert got == {(i, 0) for i in range(1, 200)} | {(501, 500)}


def test_mixing(docs, spark):
    con = duckdb.connect()
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    want = con.execute(mixing.ORACLE).fetchall()
    rows = mixing.mix_report(docs).collect()
    cols = ("doc_id", "size", "source_size", "target", "taken", "times")
    totals = Counter()
    for r in ROWS:
        totals[r[3]] += len(words(r[1]))
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    # one source has nearly all words, so the others reach three times their own
    assert {(r.source_size, round(r.target)) for r in rows if r.source_size < 5000} == {(n, 3 * n) for n in totals.values() if n < 5000}
    single = [tuple(r[c] for c in cols) for r in rows if r.doc_id not in (None, 42)]
    assert sorted(single, key=str) == sorted([w for w in want if w[0] not in (None, 42)], key=str)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in rows)


def test_quality_rules(docs):
    def base(t):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        tri = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))

    got = quality_rules.quality_report(docs).collect()
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted([(r[0], *base(r[1])) for r in ROWS], key=str)
    assert not any(r.kept and r.base_failed for r in got)
    # the English reference is mostly one word repeated 30,000 times, the German one is prose
    assert {r.doc_id for r in got if r.kept} >= set(range(12, 24))
    assert quality_rules.good_quality(docs).columns == docs.columns


def test_distance(spark):
    p, q = np.array([0.5, 0.3, 0.2, 0.0]), np.array([0.1, 0.2, 0.3, 0.4])
    h = lambda x: -sum(v * np.log2(v) for v in x if v)
    want = round((h((p + q) / 2) - (h(p) + h(q)) / 2) ** 0.5, 9)
    got = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>").select(quality_rules.distance(*map(__import__("pyspark").sql.functions.col, "pq")).alias("d")).first().d
    assert abs(got - want) < 1e-8


def test_line_templates(spark):
    rows = [(i, f"{prose(EN, 30)}\nCopyright {1990 + i} by {R.choice(EN)} all rights reserved\n\nunique line {prose(DE, 9)}") for i in range(20)]
    rows += [(90, None), (91, ""), (None, "Copyright 7 by xyz all rights reserved"), (92, "rare line here")] + [(93 + i, "the same text\nthe same line") for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _line int")
    got = {r.doc_id: r for r in templates.template_report(df).collect()}
    assert len(got) == len(rows) and all(got[i].n_dropped == 1 and got[i].n_lines == 3 for i in range(20))
    assert got[None].n_dropped == 1 and got[None].chars_left == 0 and got[92].n_dropped == got[100].n_dropped == 0
    left = {r.doc_id: r.text for r in templates.without_lines(df).collect()}
    assert left[90] is None and left[3] == "\n".join(x for x in rows[3][1].split("\n") if not x.startswith("Copyright"))


def test_long_line_in_two_texts(spark):
    passage = " ".join(f"w{i}x" for i in range(60))
    rows = [(i, f"{prose(EN, 40)}\n{line}\n{prose(DE, 40)}") for i, line in enumerate([passage, passage.replace(" ", "  "), passage + " more"])]
    rows += [(3, "twice in one text\ntwice in one text"), (4, "twice in one text\ntwice in one text")]
    got = {r.doc_id: r for r in templates.template_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in range(5)] == [1, 1, 0, 0, 0]


def test_identical_lines_of_fields(spark):
    """Few or no constant tokens: no template, but the same line all the same."""
    lines = ["Page 1 of 20", "Copyright 2020", "v1.2 build 345 released", "1 2 3 4", "Advertisement"]
    rows = [(i, "\n".join([*lines, prose(EN, 20), f"{i}7 {i}8"])) for i in range(9)]
    got = templates.template_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.n_lines, r.n_dropped) for r in got} == {(7, 5)}


def test_languages(docs, spark):
    got = language.languages(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i < 12 else "de") and by[i].score > 0.6 for i in range(24))
    assert by[44].lang_pred == by[45].lang_pred == by[46].lang_pred == by[51].lang_pred == "und" and by[51].score == 0
    kept = language.in_known_language(docs)
    assert kept.columns == docs.columns and not {44, 45, 46, 51} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in language.languages(docs.withColumn("lang", docs.lang.substr(99, 1)).where("lang is null")).collect()} == {"und"}


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    emit, start, move = r.random((7, 3)) + 0.1, r.random(3) + 0.1, r.random((3, 3)) + 0.1
    lengths = np.array([4, 2, 1])
    gamma, moved = language.forward_backward(emit, start, move, lengths)
    at, want_moves = 0, np.zeros((3, 3))
    for n in lengths:
        total, marg, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            p = start[path[0]] * np.prod([emit[at + t, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                marg[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(gamma[at : at + n], marg / total)
        want_moves += pairs / total
        at += n
    assert np.allclose(moved, want_moves)


def test_quality_scores(docs, spark):
    labels = spark.createDataFrame([(i, int(i != 49 and i != 50), None) for i in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = ranker.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in ranker.quality_scores(docs, labels.where("quality = 1")).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op5_quality_classifier(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) > 0.95 * len(rows)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in queries.op9_language_id(spark, d).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.97 * len(rows)


def test_empty_tables(docs, spark):
    none = docs.where("doc_id = -1")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        exact.exact_groups(none), exact.without_copies(none), near.near_report(none), near.without_near_copies(none), mixing.mix_report(none), mixing.mixed(none),
        quality_rules.quality_report(none), templates.template_report(none), language.languages(none), language.in_known_language(none), ranker.quality_scores(none, labels),
    ):
        assert out.collect() == []


def test_pipeline(docs, spark, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    table, counts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        table = step(spark, table, str(tmp_path))
        table.write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(table.count())
        assert i == 4 or table.columns == docs.columns
    ids = [r.doc_id for r in table.collect()]
    assert rows_of(corpus_pipeline.run(spark, str(tmp_path)).drop("ids")) == rows_of(table.drop("ids"))
    assert counts[0] > counts[1] > counts[2] and len(ids) == counts[3] and all(r.exact for r in table.collect())
    assert not {44, 45, 46, 51} & set(ids) and max(Counter(ids).values()) <= 3
