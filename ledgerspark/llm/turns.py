"""Conversation structure repair: cheapest edits by a Viterbi search whose survivors coalesce.

A repaired conversation reads `(s?(ua)+)?` in role initials.  After each row a state says what
the repaired conversation ends in: nothing yet, a system row, a user row, an assistant row.
Rows are kept (0), re-roled (3) or deleted (4, the only way for blank and duplicate rows);
empty rows may be inserted (3); a truncated row that stays adds 3.  Of equally cheap repairs
the one with the ASCII-least string of edit initials wins.

One survivor a state is held, as a leaf of a tree of backpointers with reference counts.  A
branch that no survivor needs is freed at once; as soon as the root has a single child left,
all survivors share it and its edit is final and emitted.  A survivor that another one beats
whatever follows is dropped, so ordinary conversations resolve after a row or two.  Equally
cheap paths are compared over their complete unresolved suffixes: all strings that end with
the same row differ before one of them ends, so their order is carried from row to row as a
rank.  Inserts are written before the row that follows them (at the end, after the last one);
before a deleted row they could only make the string larger.

Long conversations are cut into chunks of CHUNK rows along the sort order, the unresolved
suffix never exceeds one.  A conversation that spans chunks is solved in two passes: each
chunk gives the cost and the rank of the best way from every state to every state, a scan
over these small tables fixes the states at the borders, then the chunks are solved on their
own.  Equal rows collapse to a count before anything is sorted.  SHA-256 of the repaired text
is a chain by nature: the rows that stay stream through it in order, batch by batch.

Defined cases: null roles and texts count as one space, null turns come first, rows of the
same turn go by role, then text; a null conv_id is a conversation of its own; a role other
than system, user or assistant counts by its initial; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
#: Rows of a chunk as a power of two, and rows of an Arrow batch that carries texts.
CHUNK_BITS, TEXT_ROWS = 16, 256
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
_DIGEST_OF_NOTHING = hashlib.sha256(b"").hexdigest()


def _after_row(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None where it must not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _moves(initial: str, stays: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, edits) of the best ways over one row."""
    best = {(x, x): (DELETE, "D") for x in range(4)}
    for x in range(4) if stays else ():
        state, inserts = x, 0
        while inserts < 3:
            for cost, edit, role in ((KEEP, "K", initial), (REROLE, "R", "u"), (REROLE, "R", "a")):
                y = _after_row(state, role)
                if y is not None:
                    way = (cost + TRUNCATED * truncated + INSERT * inserts, "I" * inserts + edit)
                    best[x, y] = min(best.get((x, y), way), way)
            state, inserts = _INSERTED[state], inserts + 1
    return [(x, y, *way) for (x, y), way in best.items()]


MOVES = {(i, stays, cut): _moves(i, stays, cut) for i in ("s", "u", "a", "") for stays in (False, True) for cut in (False, True)}
#: How much dearer the first state may be than the second and still lead to a cheapest repair.
_SLACK = [(START, SYSTEM, 6), (START, USER, 7), (START, ASSISTANT, 4), (SYSTEM, START, 0), (SYSTEM, USER, 3), (SYSTEM, ASSISTANT, 0), (USER, ASSISTANT, 3), (ASSISTANT, USER, 3)]

#: state -> (cost, rank of the path among the survivors)
Survivors = dict[int, tuple[int, int]]


def advance(now: Survivors, moves: Iterable[tuple]) -> dict[int, tuple]:
    """The best path into each state: (cost, rank before, edits, state before), hopeless ones left out."""
    found = {}
    for x, y, cost, edit in moves:
        if x in now:
            way = (now[x][0] + cost, now[x][1], edit, x)
            if y not in found or way < found[y]:
                found[y] = way
    hopeless = {a for a, b, slack in _SLACK if a in found and b in found and found[a][0] > found[b][0] + slack}
    return {y: way for y, way in found.items() if y not in hopeless} if hopeless else found


def ranked(found: dict[int, tuple]) -> Survivors:
    """Survivors with their rank: by the rank of the path so far, then by the edits of this row."""
    if len(found) == 1:
        return {y: (way[0], 0) for y, way in found.items()}
    order = sorted(found, key=lambda y: found[y][1:3])
    return {y: (found[y][0], rank) for rank, y in enumerate(order)}


class Backpointers:
    """Tree of edits with reference counts; its leaves are the survivors.

    A node is [parent, edit, children, sum of the children's numbers]: with one child left,
    the sum names it.
    """

    def __init__(self, state: int):
        self.nodes, self.root, self.leaves, self.next = {0: [None, None, 0, 0]}, 0, {state: 0}, 1

    def grow(self, found: dict[int, tuple]) -> list:
        """New leaves below the old ones; the edits that are final now, in row order."""
        leaves = {}
        for y, (_, _, edit, x) in found.items():
            parent = self.nodes[self.leaves[x]]
            parent[2] += 1
            parent[3] += self.next
            self.nodes[self.next] = [self.leaves[x], edit, 0, 0]
            leaves[y] = self.next
            self.next += 1
        for leaf in self.leaves.values():
            self._free(leaf)
        self.leaves = leaves
        final = []
        while self.nodes[self.root][2] == 1:
            child = self.nodes[self.root][3]
            final.append(self.nodes[child][1])
            del self.nodes[self.root]
            self.root = child
            self.nodes[child][0] = None
        return final

    def _free(self, at: int) -> None:
        while at != self.root and self.nodes[at][2] == 0:
            parent = self.nodes.pop(at)[0]
            self.nodes[parent][2] -= 1
            self.nodes[parent][3] -= at
            at = parent

    def close(self, state: int) -> list:
        """The edits still open, up to the survivor of `state`."""
        out, at = [], self.leaves[state]
        while at != self.root:
            out.append(self.nodes[at][1])
            at = self.nodes[at][0]
        return out[::-1]


def cheapest_end(now: Survivors) -> int:
    return min(now, key=lambda s: (now[s][0] + INSERT * len(_TAIL[s]), now[s][1]))


def _row_moves(initial: str, copies: int, stays: bool, truncated: bool) -> list[tuple]:
    """Moves over equal rows: the first may stay, its repeats must go."""
    moves = MOVES[initial if initial in "sua" else "", stays, truncated]
    return [(x, y, cost + DELETE * (copies - 1), edit + "D" * (copies - 1)) for x, y, cost, edit in moves] if copies > 1 else moves


def repair(rows: Iterable[tuple], entry: int = START, leave: int | None = None, last: bool = True) -> Iterator[str]:
    """The edits of each row (initial, copies, stays, truncated), as soon as they are final.

    `entry` and `leave` are the states at the borders of a chunk; a conversation in one chunk
    leaves where it is cheapest.  `last`: inserts at the end belong to this chunk.
    """
    now, tree, held = {entry: (0, 0)}, Backpointers(entry), None
    for row in rows:
        found = advance(now, _row_moves(*row))
        now = ranked(found)
        for edit in tree.grow(found):  # the latest final edit is held: the tail may belong to it
            if held is not None:
                yield held
            held = edit
    end = cheapest_end(now) if leave is None else leave
    edits = ([] if held is None else [held]) + tree.close(end)
    if edits and last:
        edits[-1] += _TAIL[end]
    yield from edits


def crossing(rows: Iterable[tuple]) -> tuple[list[int], list[int]]:
    """Costs and ranks (-1: no way) from each state before a chunk (outer) to each after it."""
    at = {entry: {entry: (0, 0)} for entry in range(4)}
    for row in rows:
        moves = _row_moves(*row)
        at = {entry: ranked(advance(now, moves)) for entry, now in at.items()}
    cells = [at[x].get(y, (-1, -1)) for x in range(4) for y in range(4)]
    return [c for c, _ in cells], [r for _, r in cells]


def borders(chunks: Iterable[tuple[list[int], list[int]]]) -> Iterator[tuple[int, int]]:
    """States before and after each chunk of one conversation, as soon as they are final."""
    now, tree, any_chunk = {START: (0, 0)}, Backpointers(START), False
    for costs, ranks in chunks:
        any_chunk = True
        moves = [(i // 4, i % 4, cost, ranks[i]) for i, cost in enumerate(costs) if cost >= 0]
        found = advance(now, moves)
        now = ranked(found)
        yield from tree.grow({y: (cost, rank, (x, y), x) for y, (cost, rank, _, x) in found.items()})
    if any_chunk:
        yield from tree.close(cheapest_end(now))


# ---- Spark side


def _conversation(conv: Column) -> Column:
    """A key without nulls."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`conv_id`, `turn`, `role`, `text`, `copies`: rows damaged by a checksum of conversation and turn."""
    space = F.lit(" ")
    conv, turn = F.col(conv_col), F.col(turn_col)
    way = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), space), F.coalesce(F.col(text_col), space)
    rows = df.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("_role"), text.alias("_text"), way.alias("_way")).where("_way != 0")
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_way") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"), F.when(F.col("_way") == 3, 2).otherwise(1).alias("copies"),
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """Staged: distinct rows with `copies`, `_pos` (the place in the order of conversation, turn, role, text) and what the repair needs to know."""
    distinct = rows.groupBy(_conversation(F.col("conv_id")).alias("_conv"), "turn", "role", "text").agg(F.sum("copies").cast("long").alias("_n"))
    # bounds of ranges travel to the driver: the start of a text places it, the whole text sorts it
    dealt = distinct.repartitionByRange("_conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("_conv", "turn", "role", "text")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return stage(
        dealt.select(
            "_conv", "turn", "role", "text", "_n", F.monotonically_increasing_id().alias("_pos"), F.unhex(same).alias("_same"), F.substring("role", 1, 1).alias("_initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut"),
        ), "turns-in-order", TEXT_ROWS,
    )


def _chunks_of(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple]:
    """(key, rows) for consecutive equal keys; rows are a generator over `columns` and must be used up in turn."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in [*keys, *columns]), strict=True))
    first = next(rows, None)
    while first is not None:
        key, after = first[: len(keys)], [None]

        def same_key(first=first, key=key, after=after):
            yield first[len(key) :]
            for row in rows:
                if row[: len(key)] != key:
                    after[0] = row
                    return
                yield row[len(key) :]

        group = same_key()
        yield key, group
        for _ in group:
            pass
        first = after[0]


_ROW = ["_initial", "_n", "_stays", "_cut"]


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, chunk), rows in _chunks_of(batches, ["_conv", "_chunk"], _ROW):
        costs, ranks = crossing(rows)
        yield pa.RecordBatch.from_pylist([{"_conv": conv, "_chunk": chunk, "_costs": costs, "_ranks": ranks}])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv,), rows in _chunks_of(batches, ["_conv"], ["_chunk", "_costs", "_ranks"]):
        waiting = []

        def tables(rows=rows, waiting=waiting):
            for chunk, costs, ranks in rows:
                waiting.append(chunk)
                yield costs, ranks

        for entry, leave in borders(tables()):
            yield pa.RecordBatch.from_pylist([{"_conv": conv, "_chunk": waiting.pop(0), "_entry": entry, "_leave": leave}])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_conv`, `_chunk`, `_pos`, `_edit` of each row."""
    out = []
    for (conv, chunk, entry, leave, last), rows in _chunks_of(batches, ["_conv", "_chunk", "_entry", "_leave", "_last"], ["_pos", *_ROW]):
        waiting = []

        def facts(rows=rows, waiting=waiting):
            for pos, *row in rows:
                waiting.append(pos)
                yield row

        edits = repair(facts(), START if entry is None else entry, leave, last)
        done = 0
        for edit in edits:
            out.append((conv, chunk, waiting[done], edit))
            done += 1
            if done == 1024:
                del waiting[:done]
                done = 0
            if len(out) >= 4096:
                yield _edit_batch(out)
                out = []
    if out:
        yield _edit_batch(out)


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, chunk, pos, edit = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(chunk, pa.int64()), pa.array(pos, pa.int64()), pa.array(edit, pa.string())], ["_conv", "_chunk", "_pos", "_edit"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each repaired conversation; a row's edit comes before its text."""
    for (conv,), rows in _chunks_of(batches, ["_conv"], ["_edit", "role", "text"]):
        state, digest, between, edit = START, hashlib.sha256(), b"", ""
        for now, role, text in rows:
            if now is not None:
                edit = now
                continue
            for e in edit:
                if e == "D":
                    continue
                if e == "K":
                    state, line = _after_row(state, role[:1]), f"{role}:{text}"
                else:
                    state = _INSERTED[state]
                    line = f"{_ROLES[state]}:{text if e == 'R' else ''}"
                digest.update(between + line.encode())
                between = b"\n"
            edit = ""
        yield pa.RecordBatch.from_pylist([{"_conv": conv, "repaired_sha256": digest.hexdigest()}])


def edits_of(
    df: DataFrame, chunk_bits: int = CHUNK_BITS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows in order, edits of each row `_conv`, `_chunk`, `_pos`, `_edit` and its facts), both staged, for conversations as they are."""
    space = F.lit(" ")
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.col(copies_col) if copies_col else F.lit(1)).alias("copies"),
    )
    rows = _in_order(rows)
    rows = rows.withColumn("_chunk", F.shiftright("_pos", chunk_bits))
    slim = rows.select("_conv", "_chunk", "_pos", "_initial", "_n", "_blank", "_cut", "_same")
    # a pair of role and text counts once: where it stands first
    firsts = slim.groupBy("_conv", "_same").agg(F.min("_pos").alias("_pos")).select("_pos", F.lit(True).alias("_first"))
    slim = slim.join(firsts, "_pos", "left").select("_conv", "_chunk", "_pos", "_initial", "_n", (F.col("_first").isNotNull() & ~F.col("_blank")).alias("_stays"), "_cut", "_blank")
    slim = stage(slim, "turns")

    chunks = slim.groupBy("_conv", "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    ends = chunks.groupBy("_conv").agg(F.min("_chunk").alias("_from"), F.max("_chunk").alias("_to")).where("_from < _to")
    spanning = stage(chunks.join(ends, "_conv").select("_conv", "_chunk", (F.col("_chunk") == F.col("_to")).alias("_last")), "spanning-chunks")
    by = ["_conv", "_chunk"]
    tables = slim.join(spanning, by, "left_semi").repartition(*by).sortWithinPartitions(*by, "_pos").mapInArrow(_crossings, "_conv string, _chunk long, _costs array<long>, _ranks array<long>")
    states = tables.repartition("_conv").sortWithinPartitions(*by).mapInArrow(_borders, "_conv string, _chunk long, _entry long, _leave long")
    states = stage(states.join(spanning, by), "border-states")
    full = slim.join(states, by, "left").withColumn("_last", F.coalesce("_last", F.lit(True)))
    edits = full.repartition(*by).sortWithinPartitions(*by, "_pos").mapInArrow(_repaired, "_conv string, _chunk long, _pos long, _edit string")
    return rows, stage(edits.join(slim.drop("_chunk", "_conv"), "_pos"), "turn-edits")


def repair_report(df: DataFrame, chunk_bits: int = CHUNK_BITS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damage, then repair: a row per original conv_id with fault counts, cost, audit and digest of the repaired text."""
    hurt = damaged(df, conv_col, turn_col, role_col, text_col)
    rows, edits = edits_of(hurt, chunk_bits, copies_col="copies")

    n, stays, blank = F.col("_n"), F.col("_stays"), F.col("_blank")
    shown = F.when(F.col("_edit").rlike("[KR]") & F.col("_cut"), TRUNCATED).otherwise(0)
    price = F.length(F.regexp_replace("_edit", "[^D]", "")) * DELETE + F.length(F.regexp_replace("_edit", "[^RI]", "")) * REROLE + shown
    by_chunk = edits.groupBy("_conv", "_chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_edit"))), lambda e: e["_edit"]), "").alias("_audit"),
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_initial"))), lambda e: e["_initial"]).alias("_initials"), F.sum(price).alias("_cost"),
        F.sum(F.when(blank, n).otherwise(0)).alias("_blank"), F.sum(F.when(blank, 0).otherwise(n - stays.cast("long"))).alias("_duplicate"),
        F.sum((stays & F.col("_cut")).cast("long")).alias("_truncated"), F.sum(n - 1).alias("_repeats"),
    )

    def pairs(initials: Column) -> Column:
        """Neighbours that must not follow each other."""
        both = F.zip_with(F.slice(initials, 2, 2**30), F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))), lambda b, a: F.concat(a, b))
        return F.size(F.filter(both, lambda p: ~p.isin(*LEGAL)))

    slim = by_chunk.select("*", (pairs(F.col("_initials")) + F.col("_repeats")).alias("_illegal"), F.element_at("_initials", 1).alias("_i"), F.element_at("_initials", -1).alias("_j"))
    listed = F.array_sort(F.collect_list(F.struct("_chunk", "_audit", "_i", "_j")))
    seams = pairs(F.flatten(F.transform("_listed", lambda c: F.array(c["_i"], c["_j"])))) - F.size(F.filter("_listed", lambda c: ~F.concat(c["_i"], c["_j"]).isin(*LEGAL)))
    by_conv = slim.groupBy("_conv").agg(listed.alias("_listed"), *[F.sum(f"_{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    by_conv = by_conv.select(
        "_conv", "blank", "duplicate", "truncated", (F.col("illegal") + seams).alias("illegal"), "cost", F.array_join(F.transform("_listed", lambda c: c["_audit"]), "").alias("audit"),
    )

    texts = rows.select("_conv", "_pos", F.lit(None).cast("string").alias("_edit"), "role", "text")
    marks = edits.where(F.col("_edit").rlike("[KRI]")).select("_conv", "_pos", "_edit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    streamed = texts.unionByName(marks).repartition("_conv").sortWithinPartitions("_conv", "_pos", F.col("_edit").asc_nulls_last())
    hashed = stage(streamed.mapInArrow(_digests, "_conv string, repaired_sha256 string"), "repaired-digests", TEXT_ROWS)

    gaps = rows.groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("_gaps"))
    every = df.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("_conv", _conversation(F.col("conv_id")))
    out = every.join(by_conv, "_conv", "left").join(gaps, "_conv", "left").join(hashed, "_conv", "left")
    zero = F.lit(0)
    return out.select(
        "conv_id", F.coalesce("_gaps", zero).cast("long").alias("gaps"), *[F.coalesce(c, zero).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_DIGEST_OF_NOTHING)).alias("repaired_sha256"),
    )
