"""Spelling variants against brute force, with ordinary and with tiny cells."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import spelling

R = random.Random(3)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def corpus():
    stems = ["".join(R.choice("abeinrst") for _ in range(R.randint(5, 9))) for _ in range(25)] + ["straße", "élève", "Élève", "ÿÀaaaa", "aabbaabb", "x" * 300]
    words = []
    for k, stem in enumerate(stems):
        words += [stem] * R.choice([3, 20, 60])
        for _ in range(6):
            at, kind = R.randrange(len(stem)), R.randrange(4)
            c = R.choice("abeé")
            word = stem[:at] + ("" if kind == 0 else c if kind == 1 else c + stem[at] if kind == 2 else stem[at : at + 2][::-1]) + stem[at + (2 if kind == 3 else 1) :]
            words += [word] * R.choice([1, 3, 4, 9])
            twice = word[:2] + R.choice("abe") + word[2:]
            words += [twice.upper() if k % 2 else twice] * R.choice([2, 3])
    R.shuffle(words)
    rows = [(i, " ".join(words[i * 30 : i * 30 + 30])) for i in range(len(words) // 30 + 1)]
    return rows + [(None, "straße straße, Straße7straße"), (None, None), (5000, ""), (5001, "élève-élève élève"), (5002, "y" * 120_000), (5003, "y" * 120_000), (5004, "y" * 120_000)] + [rows[0]] * 2


@pytest.mark.parametrize("cell_words", [spelling.CELL_WORDS, 8])
def test_against_brute_force(spark, cell_words):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n int, word string, _part int").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, cell_words=cell_words).collect()}
    assert got == expected(rows)


def test_one_large_class_of_equal_vectors(spark):
    """Words of the same letters can't be told apart by their counts: the cell is cut into blocks."""
    words = sorted({"".join(R.sample("aaabbbccd", 9)) for _ in range(1500)})[:400]
    rows = [(i, w) for i in range(4) for w in words]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), cell_words=20).collect()}
    assert got == expected(rows)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bounded", [False, True])
def test_tree_finds_what_its_boxes_allow(bounded):
    words = ["".join(R.choice("abcdeé") for _ in range(7)) for _ in range(700)]
    found = spelling.vectors(spelling.letters(words))
    tree = spelling.Tree(found[:90] if bounded else found, 4, bounded, 64 if bounded else None)
    home = tree.home(found)
    query, leaf = tree.search(found, 1, 1)
    met = set(zip(query.tolist(), leaf.tolist(), strict=True))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if one_edit(a, b):
                assert (i, home[j]) in met
    assert len(met) < len(words) * (home.max() + 1)
    counts = Counter("bananas")
    bits = np.unpackbits(spelling.vectors(spelling.letters(["bananas"])).view(np.uint8), bitorder="little").reshape(spelling.LEVELS, spelling.DIMS)
    assert bits.sum(axis=0)[:26].tolist() == [counts[chr(97 + i)] for i in range(26)]
