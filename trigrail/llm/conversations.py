"""Conversation structure repair: the cheapest edits that give a conversation legal turns.

Rows of a conversation are kept, get another role, are deleted, or new ones are put between them, so that roles alternate from a user on, after
a system turn at most, and end with an assistant. Spark brings a conversation's rows together in order and marks their faults. A task then
takes many conversations at once, in buckets of like length: arrays with a first axis for the turn, a second for the conversation
and a third for the state (what the last turn was). From the last turn to the first the cost to the end is kept for every
state; the edits are then followed from the first turn on, all conversations of a bucket together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigrail.llm import store
from trigrail.llm import text as tx

BLANKS = "\t\n\x0b\x0c\r "
REROLE, DELETE, INSERT, TRUNCATED, NEVER = 1, 2, 5, 5, 1 << 40
#: Rows that a task gathers before it repairs them, about, and bytes of them; longest bucket by bucket a length is at most this many times the shortest.
ROWS, BYTES, WIDER = 50_000, 8 << 20, 1.25

#: States: nothing yet, after a system, a user, an assistant turn. For each: that after a new or reroled turn, and after a kept one by its kind (system, user, assistant, other; -1: not allowed).
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
END = np.array([0, NEVER, NEVER, 0], np.int64)
ROLE = np.array(["", "", "user", "assistant"], object)
#: Edits in the order in which ties are broken.
EDITS = np.frombuffer(b"DIKR", np.uint8)
MINUS_D, MINUS_I, MINUS_K, MINUS_R = range(4)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with the faults that crc32 of conv_id:turn deals out; gone ones stay, marked. Nulls of role, text and of what is hashed are one space."""
    c = store.columns(conversations, "conv_id", "turn", "role", "text")
    shown = [F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")]
    c = c.withColumn("fault", F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20)
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = c.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.explode(times).alias("_time"))
    return rows.drop("_time")


def closed(cost: np.ndarray) -> np.ndarray:
    """Least costs by state (the last axis), new turns (two at most: more lead back) included."""
    once = np.minimum(cost, INSERT + cost[..., FORCED])
    return np.minimum(once, INSERT + once[..., FORCED])


def backward(kind: np.ndarray, cut: np.ndarray, must: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Costs to the end, (turns + 1, conversations, states), of arrays (turns, conversations): kind of role, truncated, must be deleted, is a row."""
    turns, n = kind.shape
    out = np.empty((turns + 1, n, 4), np.int64)
    out[turns] = closed(np.broadcast_to(END, (n, 4)))
    for t in range(turns - 1, -1, -1):
        after = out[t + 1]
        stay = np.where(must[t], NEVER, TRUNCATED * cut[t])[:, None]
        to = KEPT.T[kind[t]]
        keep = np.where(to >= 0, np.take_along_axis(after, to.clip(0), 1), NEVER) + stay
        best = np.minimum(np.minimum(DELETE + after, keep), REROLE + stay + after[:, FORCED])
        out[t] = np.where(there[t][:, None], closed(np.minimum(best, NEVER)), after)
    return out


def traced(kind: np.ndarray, cut: np.ndarray, must: np.ndarray, there: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edit, state after it), each (turns + 1, 3, conversations): up to two new turns before a row, then what becomes of it; -1 where there is none.

    Edits are tried in the order of their letters, so that of the cheapest ways that with the least letters is followed.
    """
    turns, n = kind.shape
    edit, after_ = np.full((turns + 1, 3, n), -1, np.int8), np.full((turns + 1, 3, n), -1, np.int8)
    state, every = np.zeros(n, np.int64), np.arange(n)
    for t in range(turns + 1):
        open_ = there[t].copy() if t < turns else np.ones(n, bool)
        for step in range(3):
            left, forced = cost[t, every, state], FORCED[state]
            if t < turns:
                drop = open_ & (DELETE + cost[t + 1, every, state] == left)
            else:
                drop = np.zeros(n, bool)
                open_ &= left > 0
            new = open_ & ~drop & (INSERT + cost[t, every, forced] == left)
            edit[t, step][drop], edit[t, step][new] = MINUS_D, MINUS_I
            if t < turns:
                stay = np.where(must[t], NEVER, TRUNCATED * cut[t])
                to = KEPT[state, kind[t]]
                keep = open_ & ~drop & ~new & (to >= 0) & (stay + cost[t + 1, every, to.clip(0)] == left)
                again = open_ & ~drop & ~new & ~keep
                edit[t, step][keep], edit[t, step][again] = MINUS_K, MINUS_R
                state = np.where(keep, to, np.where(again, forced, state))
            state = np.where(new, forced, state)
            after_[t, step][open_] = state[open_]
            open_ &= new
    return edit, after_


KIND = {"s": 0, "u": 1, "a": 2}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired string"
SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired", pa.large_string())])


def _buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Conversations of like length, of which none is more than WIDER times as long as another."""
    order = np.argsort(lengths, kind="stable")
    sizes, lo = lengths[order], 0
    while lo < len(order):
        hi = int(np.searchsorted(sizes, max(8, int(sizes[lo] * WIDER)), "right"))
        hi = max(lo + 1, min(hi, lo + max(1, 4_000_000 // (int(sizes[hi - 1]) + 1))))
        yield order[lo:hi]
        lo = hi


def repaired(table: pa.Table) -> pa.RecordBatch:
    """One row a conversation, of whole conversations' rows in order: conv_id, turn, role, text, gone, blank, duplicate, truncated."""
    raw = table.column("conv_id")
    ids = raw.fill_null(0).to_numpy()
    null = raw.is_null().to_numpy().astype(bool)
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    owner = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    convs = len(first)

    rows = np.flatnonzero(~table.column("gone").to_numpy())
    live = table.take(pa.array(rows))
    owner = owner[rows]
    n = np.bincount(owner, minlength=convs)
    start = np.cumsum(n) - n
    blank, duplicate, cut = (live.column(c).to_numpy().astype(bool) for c in ("blank", "duplicate", "truncated"))
    initial = pc.utf8_slice_codeunits(live.column("role"), 0, 1).to_pylist()
    kind = np.array([KIND.get(x, 3) for x in initial], np.int64)
    must = blank | duplicate
    count = lambda flag: np.bincount(owner[flag], minlength=convs)
    found = {"blank": count(blank), "duplicate": count(duplicate), "truncated": count(cut)}
    pair = np.zeros(len(owner), bool)
    pair[1:] = (owner[1:] == owner[:-1]) & ~np.isin(kind[:-1] * 4 + kind[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
    found["illegal"] = count(pair)
    turn = live.column("turn")
    known = ~turn.is_null().to_numpy().astype(bool)
    found["gaps"] = _gaps(owner[known], turn.fill_null(0).to_numpy()[known], convs)

    costs, letters, texts = np.zeros(convs, np.int64), [""] * convs, [""] * convs
    said = live.column("text").to_pylist()
    role = live.column("role").to_pylist()
    for some in _buckets(n):
        longest = int(n[some].max())
        at = start[some] + np.arange(longest)[:, None]
        there = np.arange(longest)[:, None] < n[some]
        at = np.where(there, at, 0)
        k, c, m = (np.where(there, x[at], 0) if len(x) else np.zeros(at.shape, x.dtype) for x in (kind, cut, must))
        cost = backward(k, c.astype(np.int64), m.astype(bool), there)
        edit, state = traced(k, c.astype(np.int64), m.astype(bool), there, cost)
        costs[some] = cost[0, :, START]
        edit, state = edit.reshape(-1, len(some)).T, state.reshape(-1, len(some)).T
        used = edit >= 0
        turns = np.broadcast_to(np.repeat(np.arange(longest + 1), 3), used.shape)
        for j, conv in enumerate(some.tolist()):
            e, s, t = edit[j][used[j]], state[j][used[j]], turns[j][used[j]]
            letters[conv] = EDITS[e].tobytes().decode()
            lines = []
            for what, after, row in zip(e.tolist(), s.tolist(), (start[conv] + t).tolist(), strict=True):
                if what == MINUS_K:
                    lines.append(f"{role[row]}:{said[row]}")
                elif what == MINUS_R:
                    lines.append(f"{ROLE[after]}:{said[row]}")
                elif what == MINUS_I:
                    lines.append(f"{ROLE[after]}:")
            texts[conv] = "\n".join(lines)
    found["cost"] = costs
    name = pa.array(ids[first], mask=null[first])
    return pa.RecordBatch.from_arrays([name, *(pa.array(found[c].astype(np.int64)) for c in COUNTS), pa.array(letters, pa.string()), pa.array(texts, pa.large_string())], schema=SCHEMA)


def _gaps(owner: np.ndarray, turn: np.ndarray, convs: int) -> np.ndarray:
    """Turns that are missing between the first and the last; turns ascend in a conversation."""
    out = np.zeros(convs, np.int64)
    if len(owner):
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        new = np.ones(len(owner), np.int64)
        new[1:] = (owner[1:] != owner[:-1]) | (turn[1:] != turn[:-1])
        last = np.concatenate((edge[1:], [len(owner)])) - 1
        out[owner[edge]] = turn[last] - turn[edge] + 1 - np.add.reduceat(new, edge)
    return out


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters), repaired (role:text by lines).

    rows: conv_id, turn, role, text, gone (rows that only name their conversation). A conversation's rows are taken by turn (nulls first), role and
    text, so that equal rows stand together; conv_id null is a conversation too. Role and text must not be null. A
    conversation is worked on in one task, as a text is, and many short ones at once; an empty table gives none.
    """
    text = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("blank", text == "").withColumn("duplicate", ~F.col("blank") & (F.row_number().over(seen) > 1))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.right(text, F.lit(1)).isin(".", "!", "?"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.select("conv_id", "turn", "role", "text", "gone", "blank", "duplicate", "truncated").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        enough, most = ROWS, BYTES
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= enough or size >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                same = pc.equal(table.column("conv_id"), table.column("conv_id")[-1]).fill_null(False).to_numpy()
                same |= table.column("conv_id").is_null().to_numpy() & (not table.column("conv_id")[-1].is_valid)
                lo = n - int(same.sum())  # the last conversation may go on
                if lo:
                    yield repaired(table.slice(0, lo).combine_chunks())
                rest = table.slice(lo).combine_chunks()
                held, n, size = rest.to_batches(), n - lo, rest.nbytes
                enough, most = max(ROWS, 2 * n), max(BYTES, 2 * size)
        if n:
            yield repaired(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(tx.lean(run), RESULT)
