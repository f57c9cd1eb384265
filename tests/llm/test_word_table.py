"""The table of words: what stays when room is made, and words that share a key."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from ledgerspark.llm import pieces, repair
from ledgerspark.llm.wordtable import WordTable

WORDS = "word_bpe_49k.json"


def test_words_that_came_again_stay_when_room_is_made():
    given = []

    def encode(words):
        given.extend(words)
        return np.array([ord(c) for w in words for c in w], np.int32), np.array([len(w) for w in words], np.int64)

    table = WordTable(encode, np.int32, 8)

    def look(*texts):
        lists = [t.split() for t in texts]
        found = table.lookup(pa.array([w for ws in lists for w in ws], pa.string()), np.array([len(ws) for ws in lists]))
        assert [f.tolist() for f in found] == [[ord(c) for w in ws for c in w] for ws in lists]

    look("the cat", "", "the dog")
    look("the end of it")
    look("one two three four the cat")  # no room: `the` came again and stays, the others go
    assert given.count("the") == 1 and len(table.seen) <= 8
    look(" ".join(f"w{i}" for i in range(20)))  # more than fit: none of the old ones stays
    look("the w3")
    assert given.count("the") == 2


def test_words_of_either_case_are_given_to_the_tokenizer_once(monkeypatch):
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        rules = f.read()
    whole = Tokenizer.from_str(rules)
    added = json.loads(rules)["added_tokens"][0]["content"]
    texts = [
        "The cat THE Cat the\tCAT", None, "", "  \n ", f"{added} {added.upper()} x{added}y X{added.upper()}Y {added.title()}", "H̱ ẖ İ i̇ İ É É É",
        "It's IT'S it'S \x1cA\x1d \x0bB\x0c", "\x01 A\x01b a", "K K k ß ẞ SS",
    ]
    table, _ = repair.table_of(rules)
    table.seen.clear()
    table._hold({}, np.empty(0, np.uint32), np.empty(0, np.int64))
    given, encode = [], table.encode
    monkeypatch.setattr(table, "encode", lambda words: given.extend(words) or encode(words))
    for kind in (pa.binary(), pa.large_binary()):
        words = repair.words_in(pa.array([None, *[t and t.encode() for t in texts]], kind).slice(1))
        sizes = np.array([n or 0 for n in pa.compute.list_value_length(words).to_pylist()])
        found = table.lookup(words.flatten(), sizes, repair.keys_of(rules))
        for t, ids in zip(texts, found, strict=True):
            assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert given.count(b"the") == 1 and given.count(b"cat") == 1 and b"The" not in given and b"CAT" not in given


def test_words_keep_their_case_where_the_tokenizer_may_tell():
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        rules = json.load(f)
    for normalizer in (None, {"type": "NFC"}, {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": "A"}, "content": "b"}, {"type": "Lowercase"}]}):
        assert repair.keys_of(json.dumps({**rules, "normalizer": normalizer}))(pa.array(["", "Aa", "É"])) == [b"", b"Aa", "É".encode()]


def test_a_coder_keeps_fewer_words_than_fit_in_an_executor_beside_the_other_stages():
    assert pieces.WORDS_KEPT <= 300_000


def test_rounds_after_the_third_look_at_pairs_with_a_new_symbol_only(monkeypatch):
    seen, slot = [], repair._slot
    monkeypatch.setattr(repair, "_slot", lambda pairs: seen.append(len(pairs)) or slot(pairs))
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(200, 60_000, 20_000), np.tile(np.arange(2, 66), 20)])
    marks = np.zeros(len(ids), bool)
    marks[-1] = True
    symbols, _, rules = repair.grammar(ids, marks, 60_000)
    assert len(symbols) < 20_000 + 40 and len(rules) >= 63  # the repeated passage becomes one symbol
    assert sum(seen) < 4 * len(ids)
