import random

import numpy as np

from tests.llm.helpers import awkward, frame, prose
from voxelweave.llm import decontamination as D


def plain_distance(a, b):
    """Least edits of ``a`` to any substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.randint(1, 4) for _ in range(rng.randint(1, 70))], [rng.randint(1, 4) for _ in range(rng.randint(0, 90))]
        assert D.edit_distance(a, b) == plain_distance(a, b)


def words(text):
    import re

    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(12, 55))) for i in range(25)] + [(90, "la me"), (91, ""), (92, None), (None, prose(rng, 20)), (93, "ba")]
    rows = awkward(40)
    for n in range(60):
        k = rng.randint(0, 24)
        w = items[k][1].split()
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = rng.choice([[], ["zz"], [w[p], "yy"]])
            if not w:
                w = ["q"]
        rows.append((1000 + n, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)))
    got = {r["doc_id"]: dict(zip(r["item_ids"], r["edits"], strict=True)) for r in D.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect() if r["doc_id"] is not None}
    wrong = 0
    for doc, text in rows:
        if doc is None or len(text or "") > 15000:
            continue
        t = words(text)
        want = {}
        for i, x in items:
            m = words(x)
            if i is not None and m and (e := plain_distance(m, t)) <= int(0.2 * len(m) + 1e-9):
                want[i] = e
        wrong += set(want) != set(got[doc])
    assert wrong == 0


def test_parts_and_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 200)
    rng = random.Random(3)
    items = [(i, prose(rng, 20)) for i in range(10)]
    rows = [(i, prose(rng, 5) + " " + items[i][1]) for i in range(10)] + [(50, prose(rng, 40))]
    docs = frame(spark, rows)
    out = D.with_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert set(out.columns) == set(docs.columns)
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in out.collect()} == {**{i: [i] for i in range(10)}, 50: []}


def test_recall_and_selectivity_of_the_sampling_alone():
    rng = random.Random(8)
    vocab = prose(rng, 3000).split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(14, 59)))) for i in range(150)]
    index = D.Items([i for i, _ in items], [t for _, t in items], 0.8)
    for share, least in ((0.05, 0.99), (0.1, 0.98), (0.2, 0.95)):
        hit = seen = windows = 0
        for k, (_, text) in enumerate(items):
            w = text.split()
            for _ in range(int(share * len(w))):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocab)], [w[p], rng.choice(vocab)]])
            full = (" ".join(rng.choices(vocab, k=60) + w + rng.choices(vocab, k=60))).encode()
            h, doc = D.symbols(np.frombuffer(full, np.uint8), np.array([0, len(full)]))
            c = index.candidates(h, doc)
            near = (c[:, 1] == k) & (abs(c[:, 2] - 60) <= len(w))
            hit += bool(near.any())
            seen, windows = seen + int((~near).sum()), windows + len(h)
        assert hit >= least * len(items)
        assert seen <= 1e-3 * windows * len(items)


def test_walks_are_the_steps_one_by_one():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    bits = (D.mix64(h ^ D._ODD[0]) >> np.uint64(56)).astype(int)
    walks = D.Walks(h)
    got = walks.places(list(range(0, 300, 7)))
    for p in (0, 3, 250, 499):
        at = p
        start = p
        for t in range(300):
            if t % 7 == 0:
                assert got[t][p] == at
            if t % D.PERIOD == 0:
                start = at
            if at < 500:
                at += (bits[at] >> (t % D.PERIOD)) & 1
            if t % D.PERIOD == D.PERIOD - 1:
                at = min(max(at, start + 1), 500)


def test_a_very_long_item(spark):
    rng = random.Random(10)
    long = " ".join(f"w{rng.randrange(50000)}" for _ in range(100_000))
    items = spark.createDataFrame([(1, long), (2, prose(rng, 20))], "item_id bigint, text string")
    text = long.split()
    for _ in range(30):
        text.pop(rng.randrange(len(text)))
    got = {r["doc_id"]: r["item_ids"] for r in D.decontaminate(frame(spark, [(1, "x " + " ".join(text)), (2, long[:200000]), (3, "la me")]), items).collect()}
    assert got == {1: [1], 2: [], 3: []}


def test_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.decontaminate(frame(spark, []), none).count() == 0
    assert [r["contaminated"] for r in D.decontaminate(frame(spark, [(1, "a b"), (2, None)]), none).collect()] == [False, False]
