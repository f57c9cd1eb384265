"""Words and their features are found by numpy, the same as one at a time."""

import random
import zlib

import numpy as np
import pyarrow as pa

from ledgerspark.llm import language

ODD = ["", "é", "İstanbul ʼn ſ", "Don't stop-me 2day", "\x85a　b c", "x" * 200, "ä" * 33 + " b", "日本語" * 40 + "\tend", "\x1c\x1f a\x0bb\x0cc\rd", "𝒳𝒴 ½ Ⅷ"]


def plain_words(text):
    words = text.lower().encode().translate(None, bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \t\n\x0b\x0c\r")).split()
    out = []
    for w in words:
        while len(w) > language.PIECE:
            end = language.PIECE
            while w[end] & 0xC0 == 0x80:
                end -= 1
            out.append(w[:end])
            w = w[end:]
        out.append(w)
    return out


def plain_ids(word):
    found = [b"w" + word]
    for k in range(1, min(4, len(word)) + 1):
        found += [b"p" + word[:k], b"s" + word[-k:]]
    edged = b"^" + word + b"$"
    found += [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]
    return [zlib.crc32(f) % language.DIMENSIONS for f in found]


def texts_of(n):
    r = random.Random(3)
    return ODD + ["".join(r.choice("abcdeé ü.ß\n日") for _ in range(r.randrange(1, 300))) for _ in range(n)]


def model_of():
    model, r = language.Crf(["a", "b", "c"]), np.random.default_rng(1)
    model.weights[:], model.move[:], model.start[:] = r.normal(size=model.weights.shape), r.normal(size=(3, 3)), r.normal(size=3)
    return model


def test_words_and_features():
    for text in texts_of(100):
        assert language.word_list(text) == plain_words(text)
    words = sorted({w for t in texts_of(100) for w in plain_words(t)})
    flat, sizes = language.feature_ids(*language._listed(pa.array([b"-", *words], pa.large_binary()).slice(1)))
    want = [plain_ids(w) for w in words]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [f for fs in want for f in fs]


def test_labels_hash_no_feature_by_itself(monkeypatch):
    model, texts = model_of(), texts_of(60)
    want = []
    for text in texts:
        words = plain_words(text)
        if not any(map(str.isalpha, text)) or not words:
            want.append(("und", 0.0))
            continue
        scores = np.array([model.weights[plain_ids(w)].sum(axis=0) for w in words])
        emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30))
        gamma, _ = language.forward_backward(emit, np.exp(model.start), np.exp(model.move), np.array([len(words)]))
        share = gamma.mean(axis=0)
        want.append(("abc"[share.argmax()], share.max()))

    def refuse(*_):
        raise AssertionError("a feature hashed in Python")

    monkeypatch.setattr(language.zlib, "crc32", refuse)
    names, scores = language.Labeller(model).label([*texts, None])
    assert names == [n for n, _ in want] + ["und"] and np.allclose(scores, [s for _, s in want] + [0.0])
    one = [language.Labeller(model).label([t]) for t in texts]
    assert [n[0] for n, _ in one] == names[:-1] and np.allclose([s[0] for _, s in one], scores[:-1])
