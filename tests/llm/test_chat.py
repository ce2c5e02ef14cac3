import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from voxelweave.llm import chat as C


def plain_cost(roles):
    """Least repair cost by search over all labels and merges (short conversations)."""
    codes = C.role_codes(roles)
    best = None
    for labels in itertools.product((C.SYSTEM, C.USER, C.ASSISTANT), repeat=len(codes)):
        for merges in itertools.product((False, True), repeat=len(codes)):
            state, cost = C.START, 0
            for given, role, merge in zip(codes, labels, merges, strict=True):
                cost += 0 if given == role else C.RELABEL if given else C.LABEL
                if merge:
                    if state != role:
                        break
                    cost += C.MERGE
                else:
                    fill = C._fillers(state, role)
                    if fill is None:
                        break
                    cost += C.INSERT * len(fill)
                state = role
            else:
                cost += C.INSERT * len(C._ending(state))
                best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_least_cost_and_legal_rendering(spark, seed):
    rng = random.Random(seed)
    rows, convs = [], {}
    for c in range(30):
        n = rng.randint(1, 5)
        convs[c] = [rng.choice(["user", "assistant", "system", None, "Human", "alien", "ASSISTANT "]) for _ in range(n)]
        rows += [(c, t, r, f"t{t}", "x", 1) for t, r in enumerate(convs[c])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, fragment string, pid int")
    got = defaultdict(list)
    for r in C.repair_conversations(df, part_bytes=200).collect():
        got[r["conv_id"]].append(r)
    for c, roles in convs.items():
        mine = sorted(got[c], key=lambda r: r["turn"])
        assert len(mine) == len(roles) and sum(r["cost"] for r in mine) == plain_cost(roles)
        text = "".join(r["fragment"] for r in mine)
        turns = [t.partition("\n")[0] for t in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_end|>\n") == len(turns) and turns[-1] == "assistant"
        body = turns[1:] if turns[0] == "system" else turns
        assert body == ["user", "assistant"] * (len(body) // 2)
        assert all(f"t{t}" in text for t in range(len(roles)))


def test_one_conversation_over_many_parts(spark):
    """A conversation that holds most turns is solved in segments, at the same cost as in one piece."""
    rng = random.Random(9)
    roles = [rng.choice(["user", "user", "assistant", None, "system"]) for _ in range(3000)]
    rows = [(7, t, r, "w" * rng.randint(0, 30)) for t, r in enumerate(roles)] + [(c, 0, "user", "hi") for c in (1, 2, 90)]
    got = C.repair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), part_bytes=4000).collect()
    mine = sorted((r for r in got if r["conv_id"] == 7), key=lambda r: r["turn"])
    codes = C.role_codes(roles)
    path = C.best_path(codes, C.START, None)
    cost, state = 0, C.START
    for g, s in zip(codes, path, strict=True):
        cost, state = cost + int(C.MATRIX[g, state, s]), s
    assert sum(r["cost"] for r in mine) == cost + int(C.END[state])
    text = "".join(r["fragment"] for r in mine)
    turns = [t.partition("\n")[0] for t in text.split("<|im_start|>")[1:]]
    body = turns[1:] if turns[0] == "system" else turns
    assert body == ["user", "assistant"] * (len(body) // 2) and text.count("<|im_end|>") == len(turns)


def test_rendered_conversations(spark):
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), f"t{c}-{t}") for c in range(40) for t in range(rng.randint(1, 9))]
    repaired = C.repair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r["conv_id"]: r for r in C.rendered(repaired).collect()}
    assert sorted(got) == list(range(40))
    for c, r in got.items():
        mine = [x for x in rows if x[0] == c]
        assert r["n_turns"] == len(mine) and re.findall(r"t\d+-\d+", r["text"]) == [x[3] for x in mine]
        roles = re.findall(r"<\|im_start\|>(\w+)\n", r["text"])
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and r["text"].count("<|im_end|>") == len(roles)


def test_segments_multiply():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 37)
    whole, cost = C.reduce_segment(codes), np.array([0, C.FAR, C.FAR, C.FAR])
    for c in codes:
        cost = np.minimum((cost[:, None] + C.MATRIX[c]).min(0), C.FAR)
    assert (whole[C.START] == cost).all()


def test_nulls_ties_and_empty(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    rows = [(None, None, None, None), (None, 1, "user", "a"), (1, None, "assistant", "z"), (1, 1, "user", "q"), (1, 1, "user", "q"), (1, 1, "assistant", "<|im_start|>user")]
    got = C.repair_conversations(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and not any("<|im_start|>user\n<|im_start|>" in r["fragment"] for r in got)
    last = [r for r in got if r["conv_id"] == 1 and r["turn"] is None]
    assert last[0]["fragment"].endswith("z<|im_end|>\n")
    assert C.repair_conversations(spark.createDataFrame([], kind)).count() == 0
