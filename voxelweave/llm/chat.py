"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton.

Legal: an optional system turn, then user and assistant in turn, user first, assistant last. Every turn is
kept, relabelled or merged into the turn before; empty turns are inserted where the automaton needs them. The
cost of a run of turns is a min-plus matrix over the automaton's states, so a conversation of any length is
solved in segments: segments are reduced to matrices, the few that continue over partitions are chained on
the driver (two rows a partition), and each segment then finds its own path between known states.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_group
from voxelweave.scratch import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Costs: merge, relabel a known role, label an unknown one, insert an empty turn.
MERGE, RELABEL, LABEL, INSERT = 10, 20, 15, 30
FAR = 1 << 40
OUT = (
    "conv_id bigint, turn bigint, role string, role_out string, action string, inserted_before array<string>, inserted_after array<string>, "
    "cost bigint, fragment string, place bigint"
)
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}


def _fillers(state: int, role: int) -> list[int] | None:
    """Empty turns that make ``role`` legal after ``state``; None if nothing does."""
    if role == SYSTEM:
        return [] if state == START else None
    if role == USER:
        return [ASSISTANT] if state == USER else []
    return {START: [USER], SYSTEM: [USER], USER: [], ASSISTANT: [USER]}[state]


def _ending(state: int) -> list[int]:
    return {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]


def _moves() -> list[dict[tuple[int, int], tuple[int, str, list[int]]]]:
    """For each given role (0: unknown), the cheapest ``(cost, action, fillers)`` from state to state."""
    out = []
    for given in range(4):
        best: dict[tuple[int, int], tuple[int, str, list[int]]] = {}
        for state in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                label = 0 if given == role else RELABEL if given else LABEL
                options = [(label + MERGE, "merge", [])] if role == state else []
                fill = _fillers(state, role)
                if fill is not None:
                    options.append((label + INSERT * len(fill), "keep" if given == role else "relabel", fill))
                if options:
                    best[state, role] = min(options, key=lambda x: x[0])
        out.append(best)
    return out


MOVES = _moves()
MATRIX = np.full((4, 4, 4), FAR, np.int64)
for _given, _best in enumerate(MOVES):
    for (_a, _b), _m in _best.items():
        MATRIX[_given, _a, _b] = _m[0]
END = np.array([INSERT * len(_ending(s)) for s in range(4)], np.int64)


def role_codes(roles: list[str | None]) -> np.ndarray:
    known = {r: i for i, r in enumerate(ROLES) if r}
    name = lambda r: ALIASES.get(x := (r or "").strip().lower(), x)
    return np.array([known.get(name(r), 0) for r in roles], np.int64)


def reduce_segment(codes: np.ndarray) -> np.ndarray:
    """Min-plus product of the turns' matrices, in a logarithmic number of vector steps."""
    mats = MATRIX[codes]
    one = np.where(np.eye(4, dtype=bool), 0, FAR)
    while len(mats) > 1:
        if len(mats) % 2:
            mats = np.concatenate([mats, one[None]])
        mats = np.minimum((mats[0::2, :, :, None] + mats[1::2, None, :, :]).min(2), FAR)
    return mats[0] if len(mats) else one


def best_path(codes: np.ndarray, start: int, end: int | None) -> list[int]:
    """States after each turn of the cheapest path from ``start`` to ``end`` (None: the cheapest legal ending)."""
    cost = np.full(4, FAR, np.int64)
    cost[start] = 0
    back = np.empty((len(codes), 4), np.int8)
    for i, c in enumerate(codes):
        total = cost[:, None] + MATRIX[c]
        back[i] = total.argmin(0)
        cost = np.minimum(total.min(0), FAR)
    state = int((cost + END).argmin()) if end is None else end
    path = [0] * len(codes)
    for i in range(len(codes) - 1, -1, -1):
        path[i] = state
        state = int(back[i, state])
    return path


def _order(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """Row order (conversation, turn, nulls last, then ``tie``), the first row of each conversation and its id."""
    cols = []
    for name in ("tie", "turn", "conv_id"):
        c = t.column(name).combine_chunks()
        cols += [c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)]
    order = np.lexsort(cols)
    value, null = cols[4][order], cols[5][order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    firsts = np.flatnonzero(new)
    return order, firsts, [None if null[i] else int(value[i]) for i in firsts]


def _summary(t: pa.Table) -> pa.Table:
    """The first and the last conversation of a partition as matrices."""
    order, firsts, ids = _order(t)
    codes = role_codes(t.column("role").to_pylist())[order]
    ends = np.append(firsts[1:], len(order))
    pid = t.column("pid")[0].as_py()
    some = sorted({0, len(ids) - 1})
    mats = [reduce_segment(codes[firsts[k] : ends[k]]).ravel().tolist() for k in some]
    return pa.table({"pid": pa.array([pid] * len(some), pa.int32()), "conv_id": pa.array([ids[k] for k in some], pa.int64()), "last": pa.array([k == len(ids) - 1 for k in some]), "matrix": pa.array(mats, pa.list_(pa.int64()))})


def chain(rows: list[tuple]) -> dict[tuple, tuple[int, int | None, bool, bool]]:
    """Known states of conversations that continue over partitions: ``(pid, conv_id) -> (start, end, opens, closes)``.

    ``rows``: ``(pid, conv_id, last, matrix)`` in order of pid; the last one of a partition continues in the
    first one of the next if the ids are equal.
    """
    runs: list[list[tuple]] = []
    for r in rows:
        if runs and runs[-1][-1][1] == r[1] and runs[-1][-1][2] and runs[-1][-1][0] != r[0]:
            runs[-1].append(r)
        else:
            runs.append([r])
    out: dict[tuple, tuple[int, int | None, bool, bool]] = {}
    for run in (x for x in runs if len(x) > 1):
        cost = np.array([0, FAR, FAR, FAR], np.int64)
        back = []
        for r in run:
            total = cost[:, None] + np.array(r[3], np.int64).reshape(4, 4)
            back.append(total.argmin(0))
            cost = np.minimum(total.min(0), FAR)
        state = int((cost + END).argmin())
        for k in range(len(run) - 1, -1, -1):
            before = int(back[k][state])
            out[run[k][0], run[k][1]] = (before, state, k == 0, k == len(run) - 1)
            state = before
    return out


def _escape(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def _head(role: int, close: bool) -> str:
    return ("<|im_end|>\n" if close else "") + f"<|im_start|>{ROLES[role]}\n"


def _solver(known: dict[tuple, tuple[int, int | None, bool, bool]]):
    names = [x.strip().split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]

    def run(t: pa.Table) -> pa.Table:
        order, firsts, ids = _order(t)
        roles, texts, turns = (t.column(c).to_pylist() for c in ("role", "text", "turn"))
        codes = role_codes(roles)[order]
        pid = t.column("pid")[0].as_py()
        ends = np.append(firsts[1:], len(order))
        rows: list[tuple] = []
        for k, conv in enumerate(ids):
            start, end, opens, closes = known.get((pid, conv), (START, None, True, True))
            state = start
            mine = codes[firsts[k] : ends[k]]
            path = best_path(mine, start, end)
            for j, to in enumerate(path):
                row = int(order[firsts[k] + j])
                cost, action, fill = MOVES[mine[j]][state, to]
                tail = _ending(to) if closes and j == len(path) - 1 else []
                text = _escape(texts[row])
                if action == "merge":
                    piece = "\n" + text
                else:
                    piece = ""
                    close = state != START
                    for f in fill:
                        piece, close = piece + _head(f, close), True
                    piece += _head(to, close) + text
                for f in tail:
                    piece += _head(f, True)
                if closes and j == len(path) - 1:
                    piece += "<|im_end|>\n"
                rows.append((conv, turns[row], roles[row], ROLES[to], action, [ROLES[f] for f in fill], [ROLES[f] for f in tail], cost + INSERT * len(tail), piece, pid << 40 | firsts[k] + j))
                state = to
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def repair_conversations(turns: DataFrame, part_bytes: int = 16 << 20) -> DataFrame:
    """Repair and render conversations (``conv_id, turn, role, text``); one row per input turn.

    Returns ``conv_id, turn, role, role_out, action, inserted_before, inserted_after, cost, fragment, place``;
    fragments in order of ``place`` are the rendered conversation (see ``rendered``), and the costs add up to its repair
    cost, which is least. Among equal costs the choice is fixed.

    Nulls and edges: a null or unknown role is labelled at a lower cost than a known one is changed; a null
    text is an empty turn; a null turn number comes last, equal numbers in a fixed order of role and text;
    repeated rows are turns of their own; turns without a conversation form one; marks of the template inside
    a text are spaced out; other columns are ignored; an empty table gives an empty table.
    """
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "chat")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    total = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // part_bytes))
    dealt = rows.repartitionByRange(n, F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("tie").asc())
    parts = scratch.keep(dealt.withColumn("pid", F.spark_partition_id()), "turns")
    segments = parts.drop("text").groupBy("pid").applyInArrow(_summary, "pid int, conv_id bigint, last boolean, matrix array<bigint>")
    known = chain(sorted(((r[0], r[1], r[2], r[3]) for r in segments.collect()), key=lambda r: (r[0], r[2])))
    solve = _solver(known)
    return parts.groupBy("pid").applyInArrow(lambda t: tidy_group(solve, t), OUT)


def rendered(repaired: DataFrame) -> DataFrame:
    """``conv_id, text, cost, n_turns``: each repaired conversation as one text, from the rows of ``repair_conversations``.

    A conversation is one value here, so it has to fit a task (the turns, as above, need not); turns without a
    conversation are one (null); an empty table gives an empty table.
    """
    parts = F.sort_array(F.collect_list(F.struct("place", "fragment")))
    grouped = repaired.groupBy("conv_id").agg(parts.alias("p"), F.sum("cost").alias("cost"), F.count("*").alias("n_turns"))
    return grouped.select("conv_id", F.array_join(F.transform("p", lambda x: x["fragment"]), "").alias("text"), "cost", "n_turns")
