import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, frame, prose

from voxelweave.llm import suffix_dedup as S


def brute(rows):
    """Result of every row, in order of id (null last)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, out = {}, []
    for i in order:
        doc = float("inf") if rows[i][0] is None else rows[i][0]
        b = (rows[i][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            f = first.setdefault(b[p : p + 50], doc)
            if f < doc:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(v for v, m in zip(b, gone, strict=True) if not m)
        out.append((rows[i][0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "bucket"), [(1500, 4000), (1 << 20, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "SAMPLE_BUCKET", 2 * bucket)
    monkeypatch.setattr(S, "PARTITIONS", 5)
    rows = awkward()
    got = S.repeated_spans(frame(spark, rows), block_bytes=block).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_small_alphabet_and_exact_rims(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "".join(rng.choice(list("ab"), rng.integers(40, 300)))) for i in range(40)]
    long = "".join(rng.choice(list("abcd"), 400))
    rows += [(100 + k, long[: 49 + k]) for k in range(4)] + [(200 + k, "zz" + long[k : k + 50 + 31 * k] + "yy") for k in range(6)] + [(300, long), (301, "a" * 300), (302, "a" * 49), (303, "a" * 50)]
    got = S.repeated_spans(frame(spark, rows, False), block_bytes=900).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty(spark):
    assert S.repeated_spans(frame(spark, []), block_bytes=1000).count() == 0


def test_difference_cover():
    d = {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER}
    assert d == set(range(S.PERIOD)) and S.SHORT + S.PERIOD - 1 == S.MATCH


def test_hot_prefix(spark, monkeypatch):
    """Most suffixes begin alike, and most documents share one passage."""
    monkeypatch.setattr(S, "BUCKET", 3000)
    rng = random.Random(3)
    passage = "the same opening words of every text, again and again, " * 3
    rows = [(i, (passage if i % 3 else "") + "the same opening " * rng.randint(0, 4) + prose(rng, 15)) for i in range(60)]
    got = S.repeated_spans(frame(spark, rows, False), block_bytes=2000).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


@pytest.mark.parametrize("clash", [False, True])
def test_one_bucket_is_compared_by_bytes(monkeypatch, clash):
    """Blocks in order; a suffix is marked if an earlier document, by block and rank, has the same bytes, also where
    fingerprints of different bytes are equal."""
    if clash:
        monkeypatch.setattr(S, "fingerprint", lambda columns: columns[0] % np.uint64(3))
    rng = random.Random(4)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.choice([50, 52, 60]))).encode() for _ in range(30)]
    blocks = [[(rng.randint(0, 3), rng.choice(pieces)) for _ in range(8)] for _ in range(6)]
    parts = [np.uint32(8).tobytes() + np.array([len(t) for _, t in b], np.uint16).tobytes() + np.array([r for r, _ in b], np.int32).tobytes() + b"".join(t for _, t in b) for b in blocks]
    windows = [[((k, r), t[i : i + 50]) for r, t in b for i in range(len(t) - 49)] for k, b in enumerate(blocks)]
    first = {}
    for doc, w in (x for b in windows for x in b):
        first[w] = min(first.get(w, doc), doc)
    got = S.sort_suffixes(parts)
    assert [g.tolist() for g in got] == [[first[w] < doc for doc, w in b] for b in windows]


def test_equal_suffixes_have_equal_buckets():
    """A repeated passage goes to the same buckets as the same texts, whatever stands around it."""
    rng = random.Random(5)
    passage = prose(rng, 40)
    found = []
    for lead in ("x", "some other words before it "):
        t = pa.table({"doc_id": [1], "rid": [0], "tie": [0], "text": [lead + passage + " end " + lead]})
        block = S.Block(t)
        p = S.Pieces(block, np.ones(len(block.samples), bool), 97)
        at = {}
        for a, c, k in zip(p.first, p.count, p.piece, strict=True):
            for i in range(a, a + c):
                at[block.bytes[i : i + 50].tobytes()] = p.bucket[k]
        found.append(at)
    shared = set(found[0]) & set(found[1])
    assert len(shared) >= len(passage) - 50 and all(found[0][w] == found[1][w] for w in shared)


def test_rows_without_id(spark):
    text = "a passage that is long enough to be found by its fifty bytes, twice"
    rows = [(None, text), (None, "x " + text), (None, text), (1, "no-" + text[:50])]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in S.repeated_spans(frame(spark, rows)).collect())
    n = len(text)
    assert got[-1] == (1, 53, 0) and [r[1] for r in got[:-1]] == [n, n, n + 2]
    # equal texts without id are one document; the two different ones find each other in one direction
    assert sorted((got[0][2], got[2][2])) == [50, n] and got[0] == got[1]
