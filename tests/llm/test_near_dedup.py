import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, edited, frame, prose
from voxelweave.llm import near_dedup as N
from voxelweave.llm.text import Words


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)}) if w else frozenset()


def brute(rows, k, percent):
    docs = {}
    for doc, text in rows:
        if doc is not None:
            docs.setdefault(doc, sets(text, k))
    ids, root = sorted(docs), {d: d for d in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(docs[a] & docs[b])
            if n and 100 * n >= percent * (len(docs[a]) + len(docs[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(docs[d]), find(d)) for d in ids}


def compare(spark, rows, k, percent=80):
    want = brute(rows, k, percent)
    got = N.near_duplicates(frame(spark, rows), k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_awkward_rows(spark):
    compare(spark, awkward(), 4)
    compare(spark, awkward(40, 2), 5)


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    """Copies with 0 to 10 edits of one base: many are too far from each other, and blocks are small."""
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "COMPANY", 4)
    rng = random.Random(7)
    base = prose(rng, 120)
    rows = [(1000 - i, edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.06]))) for i in range(150)] + [(i, prose(rng, 100)) for i in range(20)]
    compare(spark, rows, 4)


def test_small_sets(spark):
    words = "ab cd ef gh ij kl mn".split()
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))) for i in range(150)]
    compare(spark, rows, 4)


def test_empty(spark):
    assert N.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in N.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_rows_that_repeat_an_id(spark):
    """Texts of one id are one node, in any order of the rows; without uniting, each text is its own."""
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (5, a + " " + "x"), (5, b), (9, b), (9, c), (12, c + " y"), (13, prose(rng, 50)), (5, a + " x"), (None, a)]
    for order in (rows, rows[::-1]):
        got = sorted(tuple(r)[:4] for r in N.near_duplicates(frame(spark, order), 4).collect() if r["doc_id"] is not None)
        assert {r[2] for r in got if r[0] in (1, 5, 9, 12)} == {1} and all(r[3] == (r[0] in (1, 13)) for r in got)
        single = N.near_duplicates(frame(spark, order), 4, unite_ids=False, row_key=F.md5("text")).collect()
        kept = {(r["doc_id"], r["row_key"]): r["kept"] for r in single if r["doc_id"] is not None}
        key = lambda t: hashlib.md5(t.encode()).hexdigest()
        assert kept[1, key(a)] and not kept[5, key(a + " x")] and kept[5, key(b)] and not kept[9, key(b)] and kept[9, key(c)] and not kept[12, key(c + " y")]


@pytest.mark.parametrize("blank", [None, "", " \t\n", "\x0b"])
def test_a_blank_text_of_an_id_takes_no_link_away(spark, blank):
    t = prose(random.Random(3), 60)
    rows = [(1, t), (1, blank), (2, t + " x"), (3, prose(random.Random(4), 60)), (2, blank)]
    for order in (rows, rows[::-1]):
        got = N.near_duplicates(frame(spark, order).coalesce(1), 4).collect()
        assert sorted((r["doc_id"], r["component_id"], r["n_shingles"] > 0) for r in got) == [(1, 1, False), (1, 1, True), (2, 1, True), (2, 2, False), (3, 3, True)]


def test_new_stars_and_blocks_agree(spark, monkeypatch):
    """A group whose members often miss its first centre: all by stars and blocks, or all by blocks."""
    rng = random.Random(17)
    base = prose(rng, 100)
    rows = [(i, edited(rng, base, rng.choice([0.02, 0.04, 0.05]))) for i in range(120)]
    ask = lambda: sorted(tuple(r)[:4] for r in N.near_duplicates(frame(spark, rows), 4).collect())
    with_stars = ask()
    monkeypatch.setattr(N, "STARS", 0)
    assert ask() == with_stars and len({r[2] for r in with_stars}) > 1


def test_words_without_algebra(spark):
    """A Thue-Morse word and its complement are different words."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    got = N.near_duplicates(frame(spark, [(1, one), (2, two), (3, one), (4, one[:400]), (5, two[:400])]), 4).collect()
    assert [r["component_id"] for r in sorted(got)] == [1, 2, 1, 4, 5]


def test_densified_bins_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (5, 40, 400):
        union = rng.integers(0, 2**63, size, dtype=np.uint64)
        hit = []
        for _ in range(20):
            a, b = union[rng.random(size) < 0.9], union[rng.random(size) < 0.9]
            if len(a) and len(b):
                s = N.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
                hit.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            union = rng.integers(0, 2**63, size, dtype=np.uint64)
        assert abs(np.mean(hit)) < 0.08


def test_words_match_the_pattern():
    for text in ("", " a\tb\x0bc\x1c d ", "É é ÀB\r\nx", "a" * 50, "\x85   x"):
        raw = text.encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
