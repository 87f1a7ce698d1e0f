"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn and then user and assistant turns by turns, beginning with a user turn
and ending with an assistant turn. A turn that doesn't fit is joined to the turn before (MERGE), gets another role
(RELABEL, or KNOWN where its role is none of the three), or empty turns are put before it (INSERT each). Dynamic
programming over the automaton's states picks the cheapest repair; ties go to the earlier choice in the order of roles.

Long conversations are cut into chunks of turns. A chunk is a (min, +) matrix from state to state, chunks' matrices are
multiplied along the conversation, and each chunk is then traced back and rendered for itself between two known states.
So neither a long conversation nor one that holds a third of all turns has to meet in one task or row. Chunks go by the
turn's number; where more rows than numbers are in one (turns without a number, or with equal ones), each turn and role
is a chunk of its own there, cut by ranges of the text's hash where that is too many still. Only rows that are equal in
conversation, turn, role and text always share a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import cut, runs, scratch

#: Columns that tell a chunk from others, in the order of the turns.
KEY = ("conv_id", "chunk", "p_turn", "p_role", "p_range")
KEY_TYPES = "conv_id long, chunk long, p_turn long, p_role string, p_range long"
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, RELABEL, KNOWN, INSERT = 2, 3, 1, 2
CHUNK_TURNS = 4096
FAR = 1 << 40
#: state -> states that may follow
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _steps() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Cost from state to a turn's state, and the empty turns put between; the same state means a merge."""
    cost, between = np.full((4, 4), FAR), {}
    for s in range(4):
        reach: dict[int, tuple[int, ...]] = {}
        todo: list[tuple[int, tuple[int, ...]]] = [(s, ())]
        while todo:  # breadth first, so the first way to a state has the fewest empty turns
            at, way = todo.pop(0)
            for t in NEXT[at]:
                if t not in reach:
                    reach[t] = way
                    todo.append((t, (*way, t)))
        for t, way in reach.items():
            cost[s, t], between[s, t] = INSERT * len(way), way
        if s and MERGE <= cost[s, s]:
            cost[s, s], between[s, s] = MERGE, ()
    return cost, between


STEP, BETWEEN = _steps()


def _label(role: str | None) -> np.ndarray:
    """Cost of reading the turn as each state."""
    out = np.full(4, KNOWN)
    if role in ROLES:
        out[:] = RELABEL
        out[ROLES.index(role) + 1] = 0
    out[START] = FAR
    return out


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + STEP[None]).min(1) + _label(r), FAR)
    return m


def trace(roles: list[str | None], start: int, end: int) -> list[int]:
    """The states of the cheapest way from start to end, one a turn."""
    cost, back = np.full(4, FAR), []
    cost[start] = 0
    for r in roles:
        ways = cost[:, None] + STEP
        back.append(ways.argmin(0))
        cost = np.minimum(ways.min(0) + _label(r), FAR)
    out, at = [], end
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n"


def _crowded(base: DataFrame, chunk_turns: int) -> DataFrame:
    """(s_conv, s_chunk, s_turn, s_role, ranges) of the turns and roles in chunks of over chunk_turns rows.

    Written to the shared folder and read again, so that its size is known where it is joined.
    """
    full = base.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > chunk_turns).select(F.col("conv_id").alias("f_conv"), F.col("chunk").alias("f_chunk"))
    inside = base.join(full, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("chunk") == F.col("f_chunk")), "left_semi")
    sizes = inside.groupBy(F.col("conv_id").alias("s_conv"), F.col("chunk").alias("s_chunk"), F.col("turn").alias("s_turn"), F.col("role").alias("s_role")).agg(F.ceil(F.count("*") / chunk_turns).alias("ranges"))
    path = scratch(base.sparkSession, "crowded")
    sizes.write.parquet(path)
    return base.sparkSession.read.parquet(path)


def _pieces(base: DataFrame, crowded: DataFrame) -> DataFrame:
    """base with p_turn, p_role and p_range: null but in crowded chunks, and in the order of turn, role and hash there."""
    same = F.lit(True)
    for mine, other in (("conv_id", "s_conv"), ("chunk", "s_chunk"), ("turn", "s_turn"), ("role", "s_role")):
        same &= F.col(mine).eqNullSafe(F.col(other))
    found, there = base.join(crowded, same, "left"), F.col("ranges").isNotNull()
    nth = F.least(F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * F.col("ranges")), F.col("ranges") - 1)
    return found.select(*base.columns, F.when(there, F.col("turn")).alias("p_turn"), F.when(there, F.col("role")).alias("p_role"), F.when(there, nth).cast("long").alias("p_range"))


def repair(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """turns(conv_id, turn, role, text) as (conv_id, turn, old_role, role, action, cost, inserted, rendered).

    A row for each row of turns, in the order of (turn, role, hash of text, text) within a conversation, nulls first. action: keep,
    merge or relabel; inserted: roles of the empty turns put before it. rendered holds those, this turn, and after the
    last turn an empty assistant turn if one is missing; joined in order they are the conversation. A merged turn adds
    its text to the turn before. Null texts are empty; a null or unknown role gets the cheapest one; a null conv_id is a
    conversation of its own. Extra columns are left out.
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk_turns), F.lit(-(2**60))))
    base = base.withColumn("th", F.xxhash64("text"))
    base = _pieces(base, _crowded(base, chunk_turns))
    order = ["conv_id", "chunk", "turn", "role", "th"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, KEY):
            m = pa.array([matrix(t["role"].to_pylist()).ravel().tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(t[k].slice(0, 1).combine_chunks() for k in KEY), m], [*KEY, "m"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before and after each chunk on the conversation's cheapest way."""
        for t in runs(batches, ("conv_id",)):
            ms = t["m"].combine_chunks().flatten().to_numpy().reshape(-1, 4, 4)
            cost, back = np.full(4, FAR), []
            cost[START] = 0
            for m in ms:
                ways = cost[:, None] + m
                back.append(ways.argmin(0))
                cost = np.minimum(ways.min(0), FAR)
            cost = cost + np.array([0, INSERT * 2, INSERT, 0])
            at, found = int(cost[1:].argmin()) + 1, []
            total = int(cost[at])
            for b in reversed(back):
                found.append((int(b[at]), at))
                at = int(b[at])
            n, found = len(ms), found[::-1]
            yield pa.RecordBatch.from_arrays([*(t[k].combine_chunks() for k in KEY), pa.array([s for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()), pa.array([k == n - 1 for k in range(n)]), pa.array([total] * n, pa.int64())], [*(f"e_{k}" for k in KEY), "s", "e", "final", "cost"])

    def turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, KEY):
            roles, texts = t["role"].to_pylist(), t["text"].to_pylist()
            at = t["s"][0].as_py()
            rows = []
            for k, (role, text, state) in enumerate(zip(roles, texts, trace(roles, at, t["e"][0].as_py()), strict=True)):
                merged = at == state and BETWEEN[at, state] == ()
                way = [ROLES[x - 1] for x in BETWEEN[at, state]]
                shown = text + "\n" if merged else "".join(render(x, "") for x in way) + render(ROLES[state - 1], text)
                if k == len(roles) - 1 and t["final"][0].as_py():
                    shown += "".join(render(ROLES[x - 1], "") for x in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ()))
                rows.append((role, ROLES[state - 1], "merge" if merged else "keep" if role == ROLES[state - 1] else "relabel", way, shown))
                at = state
            old, new, action, way, shown = zip(*rows, strict=True)
            ids = [t[c].combine_chunks() for c in ("conv_id", "turn")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(old, pa.string()), pa.array(new), pa.array(action), t["cost"].combine_chunks(), pa.array(way, pa.list_(pa.string())), pa.array(shown)], ["conv_id", "turn", "old_role", "role", "action", "cost", "inserted", "rendered"])

    keyed = base.select(*KEY, "turn", "role", "th").repartition(*KEY).sortWithinPartitions(*order)
    found = keyed.mapInArrow(chunks, f"{KEY_TYPES}, m array<long>").repartition("conv_id").sortWithinPartitions(*KEY)
    states = cut(found.mapInArrow(ends, ", ".join(f"e_{c}" for c in KEY_TYPES.split(", ")) + ", s int, e int, final boolean, cost long"))
    same = F.lit(True)
    for k in KEY:
        same &= F.col(k).eqNullSafe(F.col(f"e_{k}"))
    joined = base.join(states, same).drop(*(f"e_{k}" for k in KEY))
    dealt = joined.repartition(*KEY).sortWithinPartitions(*order, "text").drop("th")
    return dealt.mapInArrow(turn_rows, "conv_id long, turn long, old_role string, role string, action string, cost long, inserted array<string>, rendered string")
