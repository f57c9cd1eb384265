"""Conversation repair against brute force over all edits, and the cases it defines."""

import hashlib
import itertools
import random
import zlib

import pytest

from ledgerspark.llm import turns

NOTHING = hashlib.sha256(b"").hexdigest()


def reads_well(initials):
    if initials[:1] == "s":
        initials = initials[1:]
        if not initials:
            return False
    return len(initials) % 2 == 0 and initials == "ua" * (len(initials) // 2)


def every_repair(rows):
    """All (cost, edits, lines) with at most two inserts in a row, over rows (role, text, must go, truncated)."""
    inserts = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    ways = [(0, "", ())]
    for role, text, must_go, cut in rows:
        ops = [(4, "D", ())]
        if not must_go:
            ops += [(3 * cut, "K", ((role, text),)), *[(3 + 3 * cut, "R", ((r, text),)) for r in ("user", "assistant")]]
        ways = [
            (c + 3 * len(i) + oc, e + "I" * len(i) + oe, out + tuple((r, "") for r in i) + line)
            for c, e, out in ways for i in inserts for oc, oe, line in ops
            if (reads := "".join(r[:1] for r, _ in out + tuple((r, "") for r in i) + line)) in ("s" + "ua" * 9)[: len(reads)] or reads == ("ua" * 9)[: len(reads)]
        ]
    return [(c + 3 * len(i), e + "I" * len(i), out + tuple((r, "") for r in i)) for c, e, out in ways for i in inserts]


def brute(rows):
    best = min((c, e, out) for c, e, out in every_repair(rows) if reads_well("".join(r[:1] for r, _ in out)))
    return best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()


def faults(rows):
    """(blank, duplicate, truncated) and the rows as the search sees them."""
    seen, n, out = set(), [0, 0, 0], []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            n[kind] += 1
        out.append((role, text, kind in (0, 1), kind == 2))
    return n, out


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
            rows += [(turn is not None, turn or 0, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
        rows.sort()
        known = {t for has, t, _, _ in rows if has}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        (blank, dup, cut), seen = faults([r[2:] for r in rows])
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, digest = brute(seen)
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, digest)
    return out


def random_rows(n, seed):
    r = random.Random(seed)
    return [("user" if x == "u" else "assistant" if x == "a" else "system" if x == "s" else "tool", f"t{i}", r.random() < 0.2, r.random() < 0.3) for i, x in enumerate(r.choice("uuuaaast") for _ in range(n))]


def as_search_rows(rows):
    return [(role[:1], 1, not gone, cut) for role, _, gone, cut in rows]


@pytest.mark.parametrize("seed", range(150))
def test_search_against_all_repairs(seed):
    rows = random_rows(seed % 5, seed)
    cost, audit, _ = brute(rows)
    found = list(turns.repair(as_search_rows(rows)))
    assert len(found) == len(rows)
    assert "".join(found) == audit if rows else not found
    assert 4 * audit.count("D") + 3 * audit.count("R") + 3 * audit.count("I") <= cost


@pytest.mark.parametrize("seed", range(60))
def test_chunks_give_the_same_edits(seed):
    rows = as_search_rows(random_rows(40, seed))
    whole = "".join(turns.repair(rows))
    for size in (1, 3, 7):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        states = list(turns.borders(map(turns.crossing, parts)))
        assert len(states) == len(parts)
        assert "".join(e for k, (p, (x, y)) in enumerate(zip(parts, states, strict=True)) for e in turns.repair(p, x, y, k == len(parts) - 1)) == whole


def test_the_tree_stays_small_and_edits_come_early():
    rows = [("u", 1, True, False), ("a", 1, True, False)] * 5000
    now, tree, open_rows = {turns.START: (0, 0)}, turns.Backpointers(turns.START), 0
    for row in rows:
        found = turns.advance(now, turns._row_moves(*row))
        now = turns.ranked(found)
        open_rows += 1 - len(tree.grow(found))
        assert len(tree.nodes) <= 16 and open_rows <= 8
    stuck = [("t", 1, True, False)] * 999  # every row must change: two ways stay open to the end, and are compared whole
    assert "".join(turns.repair(stuck)) == "D" + "R" * 998


def test_copies_are_one_row_with_a_count():
    rows = [("u", 1, True, False), ("u", 3, True, True), ("a", 2, False, False), ("a", 1, True, False)]
    single = [(i, 1, stays and k == 0, cut) for i, n, stays, cut in rows for k in range(n)]
    assert "".join(turns.repair(rows)) == "".join(turns.repair(single))


TABLE_ROWS = [
    (conv, turn, role, text)
    for conv in range(60)
    for turn, role, text in ((t, random.Random(conv * 97 + t).choice(["user", "assistant", "user", "assistant", "system", "tool"]), random.Random(conv * 31 + t).choice(["A b.", "Cut off", "Why? ", "Yes!\n", "Same.", "x"]) + ("" if t % 2 else f" {t}.")) for t in range(conv % 5))
]
EDGES = [
    (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (100, None, "user", "A."), (100, None, "assistant", None), (100, 3, None, "B."), (100, 9, "assistant", "B."),
    (101, None, "user", "A."), (101, None, "user", "A."), (102, 1, "user", "ü." * 50_000), (102, 2, "assistant", "é" * 100_000), (103, 1, "", ""), (104, 5, "system", "Be nice."),
    (105, 7, "user", "T."), (105, 7, "assistant", "T."), (105, 7, "user", "S."), (106, 1, "user", "x."), (106, 1, "user", "x."), (106, 1, "user", "x."),
]
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("chunk_bits", [turns.CHUNK_BITS, 1])
def test_report_against_brute_force(spark, chunk_bits):
    table = TABLE_ROWS + EDGES
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, _pos int, cost string").repartition(5)
    rows = turns.repair_report(df, chunk_bits).collect()
    want = expected(table)
    assert len(rows) == len(want) == len({r.conv_id for r in rows})
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id


def test_everything_dropped_and_empty_table(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    (row,) = turns.repair_report(spark.createDataFrame([(lost, 0, "user", "Hi.")], schema)).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", NOTHING)
    assert turns.repair_report(spark.createDataFrame([], schema)).collect() == []
