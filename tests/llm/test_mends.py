"""Texts without letters, grammars that run to the end, scans of archives that are cut alike."""

import numpy as np

from ledgerspark.llm import language, repair, warc


def test_texts_without_a_letter_have_no_language(spark):
    docs = [(i, t, lang) for i, (t, lang) in enumerate([("the house is old and the garden is new", "en"), ("das haus ist alt und der garten ist neu", "de")] * 30)]
    odd = [(100, "½ ² ①", None), (101, "Ⅷ", None), (102, "12 _ 7", None), (103, "é", None), (104, None, None)]
    got = {r.doc_id: r.lang_pred for r in language.languages(spark.createDataFrame(docs + odd, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in (100, 101, 102, 104)] == ["und"] * 4 and got[103] != "und"


def test_a_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(2)
    phrases = [r.integers(2, 300, r.integers(2, 60)) for _ in range(40)]
    docs = [np.concatenate([*(phrases[i] for i in r.integers(0, 40, 12)), [1]]) for _ in range(300)]
    ids, last = np.concatenate(docs), np.zeros(sum(map(len, docs)), bool)
    last[np.cumsum([len(d) for d in docs]) - 1] = True
    seq, ends, rules = repair.grammar(ids.copy(), last.copy(), 1000)
    pairs = [(a, b) for a, b, end in zip(seq[:-1].tolist(), seq[1:].tolist(), ends[:-1].tolist(), strict=True) if not end]
    assert max(np.unique(pairs, axis=0, return_counts=True)[1]) < 2 * repair.LEAST_COUNT  # runs of one symbol overlap
    assert repair._lengths(rules, 1000).max() > 32

    def spelled(symbol):
        return [symbol] if symbol < 1000 else [x for y in rules[symbol - 1000].tolist() for x in spelled(y)]

    assert [x for s in seq.tolist() for x in spelled(s)] == ids.tolist()
    assert len(seq) < len(ids) / 10


def test_scans_are_cut_alike_and_the_setting_comes_back(spark):
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    with warc._same_splits(spark):
        assert int(spark.conf.get(name)) >= 1
    assert spark.conf.get(name, None) == before
