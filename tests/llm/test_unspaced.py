"""Texts without ASCII spaces are read to their end."""

import random

from ledgerspark.llm import language


def unspaced(first, n, seed):
    r = random.Random(seed)
    return "".join(chr(first + r.randrange(80)) for _ in range(n))


def test_language_after_the_first_bytes():
    hira, kata = 0x3042, 0x30A2
    found = [(lang, language.word_list(unspaced(first, 120, i))) for i in range(40) for lang, first in (("hira", hira), ("kata", kata))]
    texts = [unspaced(hira, 14, 101) + unspaced(kata, 400, 102) + unspaced(hira, 2, 103), unspaced(kata, 14, 104) + unspaced(hira, 400, 105) + unspaced(kata, 2, 106)]
    names, scores = language.Labeller(language.learn(found)).label(texts)
    assert names == ["kata", "hira"] and scores.min() > 0.8


def test_passages_are_bounded(spark):
    rows = [(i, unspaced(0x3042, 20_000, i), "hira") for i in range(12)] + [(99, "some plain words", "en")]
    found = language.passages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len({lang for lang, _ in found}) == 2 and all(0 < len(b"".join(w).decode()) <= language.PASSAGE_CHARS for _, w in found)


def test_pieces_are_whole_characters():
    text = "a" + unspaced(0x3042, 100, 1) + "é" * 50
    assert b"".join(language.word_list(text)).decode() == text
    assert all(len(p) <= language.PIECE and p.decode() for p in language.word_list(text))
