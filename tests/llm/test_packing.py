import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, frame, prose
from voxelweave.llm import packing, tokens


def test_pieces():
    assert packing.pieces_of(1, 8) == [(0, 1)] and packing.pieces_of(8, 8) == [(0, 8)]
    assert packing.pieces_of(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.pieces_of(16, 8) == [(0, 8), (8, 8)]


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rows = awkward()
    slow = Tokenizer.from_file(tokens.tokenizer_path())
    got = packing.pack_documents(frame(spark, rows), tokens.tokenizer_path()).collect()
    want = []
    for doc, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(doc, k, s, m, zlib.crc32(ids[s : s + m].tobytes())) for k, (s, m) in enumerate(packing.pieces_of(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    n = check_layout(got, 1024)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // 1024) + 1


def test_fast_ids_are_the_tokenizers_ids():
    slow = Tokenizer.from_file(tokens.tokenizer_path())
    encode = tokens.encoder(tokens.tokenizer_path())
    rng = random.Random(3)
    texts = [prose(rng, 50), "a  b\n\n c\t\t", "don't WE'LL 12345 é ß €“x”", "<|endoftext|> x <|endoftext|>", "漢字　🙂\u0085\x1c", "x" * 3000, "  y", "﻿z"]
    texts += ["".join(chr(rng.choice([32, 10, 97, 39, 233, 8217, 0x24F, 0x2026, 0x20AC, 48])) for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def best_fit_decreasing(lengths, capacity):
    """Number of sequences of plain best-fit-decreasing."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, opened = capacity, opened + 1
        if gap > n:
            bisect.insort(gaps, gap - n)
    return opened


def test_sweep_takes_the_successor():
    rng = random.Random(5)
    for _ in range(200):
        rows = sorted(((rng.randint(1, 30), rng.random() < 0.5) for _ in range(rng.randint(1, 40))), key=lambda r: (-r[0], r[1]))
        size, piece = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        slots = np.array([rng.randint(1, 3) for _ in rows])
        stack, want, levels = [], [-1] * len(rows), {}
        for i, (_, p) in enumerate(rows):
            if not p:
                stack += [i] * slots[i]
            elif stack:
                want[i] = stack.pop()
        for level, i in enumerate(stack):
            levels.setdefault(i, []).append(level)
        to, first, left = packing.sweep_range(size, piece, slots)
        assert to.tolist() == want
        assert [int(x) for x in left] == [len(levels.get(i, [])) for i in range(len(rows))]
        assert all(first[i] == v[0] for i, v in levels.items())


def test_carry_is_the_sweep_of_all_ranges():
    rng = random.Random(6)
    for _ in range(100):
        ranges = [(p, rng.randint(0, 5), rng.randint(0, 5)) for p in range(6)]
        stack, want = [], []
        for p, pieces, slots in ranges:
            for k in range(pieces):
                if stack:
                    want.append((p, k, *stack.pop()))
            stack += [(p, s) for s in range(slots)]
        got = [(p, r + k, of, top - k) for p, r, n, of, top in packing.carry_runs(ranges) for k in range(n)]
        assert got == want


def test_no_more_sequences_than_best_fit_decreasing(spark):
    rng = np.random.default_rng(7)
    draws = [
        (64, rng.integers(1, 65, 700)), (64, rng.integers(8, 22, 900)), (1024, rng.integers(1, 1025, 900)), (1024, np.clip(rng.lognormal(5, 1.3, 1200).astype(int), 1, 1024)),
        (64, np.repeat([40, 21, 3], [300, 500, 900])),
    ]
    for k, (capacity, lengths) in enumerate(draws):
        rows = [(i, 0, int(n)) for i, n in enumerate(lengths)]
        frame_ = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint")
        want = best_fit_decreasing(lengths.tolist(), capacity)
        packed = []
        for range_rows in (10_000, 150) if k in (1, 3) else (10_000,):
            got = packing.pack(frame_, capacity, range_rows=range_rows).collect()
            assert sorted(tuple(r)[:3] for r in got) == rows
            assert check_layout(got, capacity) <= want
            packed.append(sorted(map(tuple, got)))
        assert all(p == packed[0] for p in packed)


def test_range_size_does_not_change_the_packing(spark):
    """Pieces of the length at which ranges used to open sequences of their own, and a hot length among others."""
    rng = np.random.default_rng(11)
    for lengths in (rng.integers(330, 520, 1500), np.concatenate([np.repeat(345, 700), rng.integers(1, 400, 700)])):
        rows = [(i, 0, int(n)) for i, n in enumerate(lengths)]
        frame_ = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint")
        once, often = (sorted(map(tuple, packing.pack(frame_, 1024, range_rows=r).collect())) for r in (200_000, 200))
        assert once == often


def test_hot_length_and_empty(spark):
    rows = [(i, "ba ce di") for i in range(3000)] + [(5000, "la " * 900)]
    got = packing.pack_documents(frame(spark, rows, False), tokens.tokenizer_path(), capacity=64).collect()
    n = check_layout(got, 64)
    per = got[0]["length"]
    assert len(got) >= 3000 and n >= -(-sum(r["length"] for r in got) // 64) and per > 0
    assert packing.pack_documents(frame(spark, []), tokens.tokenizer_path()).count() == 0
