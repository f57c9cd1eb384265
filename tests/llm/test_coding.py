import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ledgerspark.llm import pieces, repair

ODD = ["", None, " ", "a", "  two  spaces ", "tab\tand\nline", "▁mark", "日本語のテキスト", "naïve café ÀÉ", "x" * 3000, "1234567 3.14", "🙂🙂 ok", "don't stop", "́a", "ab " * 500, "aaaaaaaaaaaaaaaaaaaaaaab", "<|endoftext|> x", "İstanbul ΑΣ", "\x1c\x85　z", "\n\n\n"]


def texts(n=300):
    r = random.Random(3)
    bits = ["the", "ing", "tion", "er", "in", "on", "ß", "é", " ", " ", "  ", "\n", "Q", "zz", "!", "12", "th", "hel", "lo", "world", "ctrl", "日", "ab"]
    return ODD + ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(n)]


def test_pieces_are_those_of_the_library():
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    sp, coder = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Coder(data)
    for t, ids in zip(texts(2000), coder.encode(texts(2000)), strict=True):
        assert ids.tolist() == sp.encode(t or ""), repr(t)
        assert coder.decode(ids) == (t or "").replace("▁", " ")


def test_coded_table(spark):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 2), (3, "a", 3)], "doc_id long, text string, ids int")
    rows = pieces.coded_report(df, data).collect()
    assert len(rows) == len(ODD) + 2
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    for r in rows:
        if r.doc_id is not None:
            ids = sp.encode(ODD[r.doc_id] or "")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert r.exact == ("▁" not in (ODD[r.doc_id] or ""))
    assert pieces.coded_report(df.where("doc_id = -1"), data).collect() == []


def test_token_shards(spark):
    text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    whole = Tokenizer.from_str(text)
    rows = list(enumerate(texts(200)))
    df = spark.createDataFrame(rows[::-1] + [(5000, "hi there " * 4000)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repair.shard_report(df, text, shard_ids=3000).collect()}
    start = 0
    for i, t in [*rows, (5000, "hi there " * 4000)]:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        start += len(ids)
    assert repair.shard_report(df.where("doc_id = -1"), text).collect() == []


def test_any_span_of_a_shard():
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(2, 9, n), 1).astype(np.uint32) for n in (0, 5, 4000, 1, 700)] + [np.array([3] * 500 + [1], np.uint32)]
    shard = repair.Shard(repair.pack([1, None, 3, 4, 5, 6], docs, 100))
    assert len(shard.symbols) < 0.6 * shard.n_ids and shard.doc_ids[1] is None
    assert all((a == b).all() for a, b in zip(shard.all_ids(), docs, strict=True))
    for _ in range(200):
        d = int(r.integers(0, 6))
        i, j = sorted(r.integers(0, len(docs[d]) + 1, 2))
        assert (shard.ids(d, int(i), int(j)) == docs[d][i:j]).all()
