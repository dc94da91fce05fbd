"""Conversation repair: the cheapest edits that make a conversation's turns legal.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant. Every
turn is kept, given another role, or deleted, and empty turns may be inserted anywhere. Of the cheapest
ways the one whose edits read first in ASCII order is taken.

The dynamic program runs backwards over four states (nothing yet, after system, after user, after
assistant) and holds their costs only at checkpoints, one every square root of a conversation's turns:

1. A block of turns between two checkpoints becomes a matrix: from each state before it to each state
   after it, the least cost. Blocks of all conversations are worked on independently.
2. Per conversation the matrices, as many as the square root of its turns, give the vector of costs at
   every checkpoint.
3. Each block recomputes its own vectors from the checkpoint behind it and walks forward over the tight
   edits, once for each state it may be entered in.
4. Per conversation the states at the checkpoints are walked through, which picks one walk of each block.

Turns travel as one letter each; texts are joined to their edits again by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom import session
from rankloom.llm import common
from rankloom.operators import ordering

#: Turns between two checkpoints at least.
LEAST_BLOCK = 64
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INITIALS, FAULTS = "suax", "obdt"  # role initials, other; fine, blank, duplicate, truncated
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that the one role which may follow leads to, and that role's initial, for each state.
NEXT, NEXT_ROLE = (USER, USER, ASSISTANT, USER), "uuau"
LEGAL_PAIRS = {"su", "ua", "au"}
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of ``rows`` as a faulty source would deliver them.

    Nulls of role and text read as one space. crc32 of ``conv_id:turn`` (null: a space) modulo 20 decides:
    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4
    makes its role ``user``.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    lot = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def same_conv(*more: str) -> Column:
    """Null-safe match of ``conv`` and ``_conv``, plain match of the further columns."""
    match = F.col("conv").eqNullSafe(F.col("_conv"))
    for column in more:
        match = match & (F.col(column) == F.col(f"_{column}"))
    return match


def other(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumnsRenamed({"conv": "_conv"} | {k: f"_{k}" for k in keys})


def ordered(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, pos, n``: turns in order (nulls first, ties by role and text), and how many."""
    own = rows.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    placed = ordering.group_rank(own, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], "pos", hot_rows=0)
    counts = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    return session.stage(ordering.attach(placed, counts, ["conv"], size="n"))


def judged(rows: DataFrame) -> DataFrame:
    """``conv, turn, pos, n, block, kind``: one letter per turn for its role's initial and its first fault."""
    text = F.rtrim("text", F.lit(BLANKS))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = rows.select(
        "conv", "turn", "pos", "n", block().alias("block"), said.alias("said"), (text == "").alias("blank"),
        F.substring(text, -1, 1).isin(".", "!", "?").alias("ended"), F.substring("role", 1, 1).alias("initial"))
    first = narrow.groupBy("conv", "said").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    found = narrow.join(other(first, "pos"), same_conv("pos"), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("ended"), 3).otherwise(0)
    initial = F.when(F.col("initial").isin(*"sua"), F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(3)
    return session.stage(found.select("conv", "turn", "pos", "n", "block", F.char(65 + 4 * initial + fault).alias("kind")))


def interval() -> Column:
    """Turns between two checkpoints of a conversation of ``n`` turns."""
    return F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("n"))).cast("long")


def block() -> Column:
    return F.floor((F.col("pos") - 1) / interval()).cast("long")


def read(kind: str) -> tuple[str, str]:
    code = ord(kind) - 65
    return INITIALS[code // 4], FAULTS[code % 4]


@lru_cache(maxsize=None)
def moves(kind: str) -> list[list[tuple[str, int, int]]]:
    """For each state, what can be done with a turn: ``(edit, cost, state after it)`` in ASCII order."""
    initial, fault = read(kind)
    extra = CUT if fault == "t" else 0
    found = []
    for state in STATES:
        own = [("D", DELETE, state)]
        if fault not in "bd":
            if (state, initial) in FOLLOWS:
                own.append(("K", extra, FOLLOWS[state, initial]))
            own.append(("R", REROLE + extra, NEXT[state]))
        found.append(own)
    return found


def inserted(cost: list[int]) -> list[int]:
    """Costs when turns may be inserted before going on with ``cost``."""
    best = list(cost)
    for _ in STATES:
        best = [min(best[s], INSERT + best[NEXT[s]]) for s in STATES]
    return best


#: Costs behind the last turn: a conversation may end where nothing was said or after an assistant.
ENDED = inserted([0, NEVER, NEVER, 0])


def step(kind: str, after: list[int]) -> list[int]:
    return inserted([min(cost + after[to] for _, cost, to in own) for own in moves(kind)])


@lru_cache(maxsize=1 << 14)
def matrix(kinds: str) -> tuple[int, ...]:
    """Least costs through a block from each state (rows) to each state (columns)."""
    columns = []
    for end in STATES:
        cost = [0 if s == end else NEVER for s in STATES]
        for kind in reversed(kinds):
            cost = step(kind, cost)
        columns.append(cost)
    return tuple(min(columns[end][begin], NEVER) for begin in STATES for end in STATES)


@lru_cache(maxsize=1 << 14)
def walks(kinds: str, after: tuple[int, ...], last: bool) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """For each state a block may be entered in: the state it is left in, and its edits turn by turn.

    Edits are ``K``, ``D``, ``Ru``, ``Ra`` and, before them, ``Iu`` and ``Ia``; turns are separated by
    commas. Of tight edits the first in ASCII order is taken. The ``last`` block has one more entry, for
    what is inserted behind the last turn.
    """
    vectors = [list(after)]
    for kind in reversed(kinds):
        vectors.append(step(kind, vectors[-1]))
    vectors.reverse()
    exits, edits = [], []
    for state in STATES:
        turns = []
        for nth, kind in enumerate(kinds):
            turn = ""
            while True:
                left = vectors[nth][state]
                if left >= NEVER:
                    break
                tight = {edit: to for edit, cost, to in moves(kind)[state] if cost + vectors[nth + 1][to] == left}
                if INSERT + vectors[nth][NEXT[state]] == left:
                    tight["I"] = NEXT[state]
                edit = min(tight)
                turn += edit + (NEXT_ROLE[state] if edit in "IR" else "")
                state = tight[edit]
                if edit != "I":
                    break
            turns.append(turn)
        if last:
            tail = ""
            while state not in (START, ASSISTANT):
                tail, state = tail + "I" + NEXT_ROLE[state], NEXT[state]
            turns.append(tail)
        exits.append(state)
        edits.append(",".join(turns))
    return tuple(exits), tuple(edits)


def _mapped(df: DataFrame, work, kept: list[str], added: str) -> DataFrame:
    """``df`` row by row: the columns ``kept`` and those that ``work`` makes of a row (a tuple)."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    arrow = to_arrow_schema(T.StructType.fromDDL(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [dict(zip(arrow.names, work(row))) for row in batch.to_pylist()]
            found = pa.RecordBatch.from_pylist(made, arrow)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found.columns], [*kept, *arrow.names])

    return df.mapInArrow(common.released(run), f"{kinds}, {added}")


def _summed(row: dict) -> tuple:
    kinds = row["kinds"]
    initials = [read(k)[0] for k in kinds]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))
    return list(matrix(kinds)), illegal, initials[0], initials[-1]


def _checkpoints(row: dict) -> tuple:
    """Cost and illegal pairs of a conversation, and the cost vector behind each of its blocks."""
    blocks = sorted(row["blocks"], key=lambda b: b["block"])
    after, behind = list(ENDED), []
    for own in reversed(blocks):
        behind.append({"block": own["block"], "after": after, "last": not behind})
        after = [min(own["matrix"][4 * s + t] + after[t] for t in STATES) for s in STATES]
    illegal = sum(b["illegal"] for b in blocks)
    illegal += sum(a["tail"] + b["head"] not in LEGAL_PAIRS for a, b in zip(blocks, blocks[1:]))
    return after[START], illegal, behind


def _entries(row: dict) -> tuple:
    state, found = START, []
    for own in sorted(row["blocks"], key=lambda b: b["block"]):
        found.append({"block": own["block"], "entry": state})
        state = own["exits"][state]
    return (found,)


def solved(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, cost, illegal)`` of each conversation, and ``(conv, block, edits)`` of each block."""
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "")
    # A block holds as many turns as there are between two checkpoints.
    blocks = session.stage(kinds.groupBy("conv", "block").agg(letters.alias("kinds")))
    summed = _mapped(blocks, _summed, ["conv", "block"], "matrix array<long>, illegal long, head string, tail string")
    gathered = summed.groupBy("conv").agg(
        F.collect_list(F.struct("block", "matrix", "illegal", "head", "tail")).alias("blocks"))
    convs = session.stage(_mapped(
        gathered, _checkpoints, ["conv"],
        "cost long, illegal long, behind array<struct<block:long,after:array<long>,last:boolean>>"))
    behind = convs.select("conv", F.explode("behind").alias("b")).select("conv", "b.block", "b.after", "b.last")
    walked = session.stage(_mapped(
        blocks.join(other(behind, "block"), same_conv("block")).select("conv", "block", "kinds", "after", "last"),
        lambda row: walks(row["kinds"], tuple(row["after"]), row["last"]),
        ["conv", "block"], "exits array<int>, edits array<string>"))
    entries = _mapped(
        walked.groupBy("conv").agg(F.collect_list(F.struct("block", "exits")).alias("blocks")),
        _entries, ["conv"], "entries array<struct<block:long,entry:int>>")
    entries = entries.select("conv", F.explode("entries").alias("e")).select("conv", "e.block", "e.entry")
    chosen = walked.join(other(entries, "block"), same_conv("block")).select(
        "conv", "block", F.expr("edits[entry]").alias("edits"))
    return convs.select("conv", "cost", "illegal"), chosen


def edited(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``conv, turn, pos, role, text, edits``: what happens before and at each turn, and behind the last."""
    met = rows.withColumn("block", block()).join(other(chosen, "block"), same_conv("block"))
    nth = (F.col("pos") - 1 - F.col("block") * interval()).cast("int")
    turns = F.split("edits", ",")
    behind = F.when(F.col("pos") == F.col("n"), F.get(turns, nth + 1)).otherwise("")
    return met.select("conv", "turn", "pos", "role", "text", F.concat(F.get(turns, nth), behind).alias("edits"))


def steps() -> Column:
    return F.expr("regexp_extract_all(edits, '([IR][ua]|[KD])', 1)")


def repaired(edits: DataFrame) -> DataFrame:
    """``conv_id, pos, nth, role, text``: the turns of the repaired conversations, in order of ``pos`` and ``nth``."""
    spread = edits.select("conv", "pos", F.col("role").alias("was"), F.col("text").alias("said"), F.posexplode(steps()).alias("nth", "step"))
    role = F.when(F.col("step") == "K", F.col("was")).when(F.col("step").endswith("u"), "user").otherwise("assistant")
    text = F.when(F.col("step").startswith("I"), "").otherwise(F.col("said"))
    return spread.where("step <> 'D'").select(F.col("conv").alias("conv_id"), "pos", "nth", role.alias("role"), text.alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of turns that come in order; a text is read and let go."""
    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [held, pa.array(["".join(audit)]), pa.array([whole.hexdigest()])], ["conv", "audit", "repaired_sha256"])

    held, audit, whole, begun = None, [], hashlib.sha256(), False
    for batch in batches:
        for nth, row in enumerate(batch.to_pylist()):
            key = batch.column("conv").slice(nth, 1)
            if held is None or key[0] != held[0] and not (not key[0].is_valid and not held[0].is_valid):
                if held is not None:
                    yield finished()
                held, audit, whole, begun = key, [], hashlib.sha256(), False
            audit.append(row["audit"])
            for line in row["lines"]:
                whole.update((b"\n" if begun else b"") + line.encode())
                begun = True
    if held is not None:
        yield finished()


def digested(edits: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256``. A digest is one chain of bytes: a conversation's texts stream through one task."""
    lines = F.expr("""transform(filter(regexp_extract_all(edits, '([IR][ua]|[KD])', 1), s -> s <> 'D'), s -> concat(
        CASE WHEN s = 'K' THEN role WHEN endswith(s, 'u') THEN 'user' ELSE 'assistant' END, ':',
        IF(startswith(s, 'I'), '', text)))""")
    pieces = edits.select("conv", "pos", F.regexp_replace("edits", "[ua]", "").alias("audit"), lines.alias("lines"))
    placed = pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos").drop("pos")
    kind = edits.schema["conv"].dataType.simpleString()
    return placed.mapInArrow(common.released(_digests), f"conv {kind}, audit string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, edits)`` of ``rows(conv_id, turn, role, text)``.

    Conversations: ``conv, gaps, blank, duplicate, truncated, illegal, cost``. Edits: one row per turn
    with the edits before and at it (see ``walks``); ``repaired`` gives the turns they result in.

    A turn is blank without anything but white space, else a duplicate if role and text came before,
    else truncated if its last character that is not white space is none of ``.!?``. Blank and duplicate turns are
    deleted. Role and text must not be null (``damaged`` sees to that); a role that starts with none of
    ``s``, ``u``, ``a``, the empty one included, cannot be kept. Null is a conversation of its own, null
    turns come first and count for no gap, equal turns go by role and text. An empty table gives empty ones.
    Other columns are neither read nor returned.
    """
    placed = ordered(rows)
    kinds = judged(placed)
    fault = (F.ascii("kind") - 65) % 4
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = kinds.groupBy("conv").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(fault == FAULTS.index(c)).cast("long").alias(name)
          for c, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    costs, chosen = solved(kinds)
    joined = stats.join(other(costs), same_conv()).select(*stats.columns, "illegal", "cost")
    return joined, edited(placed, chosen)
