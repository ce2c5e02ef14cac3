"""Substring dedup by suffix buckets with a difference-cover sample.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts in a document with a smaller id, so suffixes
need to be ordered to that depth only, and of suffixes that are equal to it, the first document counts.

1. **Cover sample.** Positions modulo ``PERIOD`` in a perfect difference set are the sample: any two suffixes meet sample
   positions at a common distance of less than ``PERIOD``. If they are equal to depth ``MATCH``, the sample suffixes there
   are equal to depth ``SHORT`` = MATCH - PERIOD + 1. So a suffix without a sample position among its next ``PERIOD`` whose
   string of that depth recurs is alone, and goes no further. Whether it recurs is asked by fingerprints; one that
   lies only lets a suffix through.
2. **Suffix buckets.** The suffixes that are left are dealt to buckets by the leading bytes of their anchor suffix, the
   one of their first positions whose ``ANCHOR`` leading bytes have the smallest hash. Equal suffixes have equal anchors,
   neighbours mostly share theirs, so a run of suffixes travels as one piece of text instead of a string each, and a
   prefix that is frequent in the corpus does not fill one bucket.
3. **Order.** One bucket at a time, its suffixes are sorted and compared as bytes; each gets a bit: an earlier document
   has it. The sort key is a fingerprint of the bytes, which only brings equal ones together: no fingerprint decides.
   (Sorting by the bytes themselves gives the same bits at twice the time of the whole query.)

As the order stops at ``MATCH`` bytes, ties longer than that need no resolution: equal to that depth is all that is
asked, and memory holds one block or one bucket. (Construction of the whole suffix order would go on from here with
ranks of the sample; nothing here would read them.)

Documents lie in blocks of consecutive ids (about ``BLOCK`` bytes), written once. A block sends every bucket its distinct
pieces, so a passage that all documents share costs a bucket one piece a block, and gets back the bits of their suffixes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_group
from voxelweave.llm.text import STEP, mix64, string_view
from voxelweave.scratch import Scratch

MATCH, PERIOD, ANCHOR = 50, 31, 12
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
SHORT = MATCH - PERIOD + 1
#: Bytes of text in a block, and behind a bucket of pieces and of sample fingerprints, on average.
BLOCK, BUCKET, SAMPLE_BUCKET = 5 << 19, 12 << 20, 24 << 20
#: Hash partitions of the block table at most (Spark refuses more than 100,000); a partition may hold many blocks.
PARTITIONS = 1 << 16
#: Positions hashed at a time.
STRIDE = 1 << 18
FRAGMENTS = "bucket int, pid int, data binary"
ANSWERS = "pid int, bucket int, data binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


class Block:
    """One block's texts in id order, each starting at a multiple of PERIOD; rows with one id have one rank
    (rows without id: one for each text)."""

    odd = mix64(np.arange(1, 20, dtype=np.uint64)) | np.uint64(1)

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        null = np.array(ids.is_null().to_pylist(), bool) if len(ids) else np.zeros(0, bool)
        value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        tie = table.column("tie").to_numpy()
        order = np.lexsort((table.column("rid").to_numpy(), tie, value, null))
        self.ids = [None if null[i] else int(value[i]) for i in order]
        value, null, tie = value[order], null[order], tie[order]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1]) | (tie[1:] != tie[:-1])
        self.rank = np.cumsum(new, dtype=np.int32) - 1
        data, offsets = string_view(table.column("text").combine_chunks()) if len(ids) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        size = np.diff(offsets)[order]
        cells = -(-size // PERIOD)
        self.start = np.concatenate([[0], np.cumsum(cells)[:-1]]).astype(np.int64) * PERIOD if len(size) else np.zeros(0, np.int64)
        self.size, self.end = size, self.start + size
        self.row_of_cell = np.repeat(np.arange(len(size), dtype=np.int32), cells)
        self.bytes = np.zeros(int(cells.sum()) * PERIOD + MATCH + 16, np.uint8)
        for r, i in enumerate(order):
            self.bytes[self.start[r] : self.end[r]] = data[offsets[i] : offsets[i + 1]]
        self.words = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,)).copy()  # the 8 bytes from each position
        grid = np.arange(0, len(self.row_of_cell) * PERIOD, PERIOD)
        self.samples = (grid[:, None] + np.array(COVER)).ravel().astype(np.int32)

    def fit(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Whether ``depth`` bytes from each position lie in its document."""
        return at + depth <= self.end[self.row_of_cell[at // PERIOD]]

    def keys(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes (64 and 32 bits) of the ``depth`` bytes from each position."""
        firsts, seconds = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
        for i in range(0, len(at), STRIDE):
            part = at[i : i + STRIDE]
            one, two = np.full(len(part), depth, np.uint64), np.full(len(part), STEP, np.uint64)
            for j, o in enumerate([*range(0, depth - 8, 8), depth - 8]):
                w = self.words.take(part + o)
                one ^= w
                one *= np.uint64(0xFF51AFD7ED558CCD)
                one ^= one >> np.uint64(32)
                w ^= w >> np.uint64(31)
                w *= self.odd[j]
                two += w
            firsts[i : i + STRIDE], seconds[i : i + STRIDE] = mix64(one), mix64(two) >> np.uint64(32)
        return firsts, seconds


def _starts(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Mask of the union of [low, high)."""
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, low, 1)
    np.add.at(mark, high, -1)
    return np.cumsum(mark[:-1], dtype=np.int32) > 0


class Fingerprints:
    """Distinct fingerprints of the block's sample strings of depth SHORT, ordered by bucket."""

    def __init__(self, block: Block, buckets: int):
        at = block.samples
        self.fits = block.fit(at, SHORT) if len(at) else np.zeros(0, bool)
        at = at[self.fits]
        self.rank = block.rank[block.row_of_cell[at // PERIOD]] if len(at) else np.zeros(0, np.int32)
        one, two = block.keys(at, SHORT)
        both = (two.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (one >> np.uint64(32))
        value, where = np.unique(both, return_inverse=True)
        self.where = where.astype(np.int32)
        self.value, bucket = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.int64)
        self.cuts = np.searchsorted(bucket, np.arange(buckets + 1))

    def fragments(self, pid: int) -> pa.Table:
        """One row per bucket that has some, byte planes first to last."""
        some = np.flatnonzero(np.diff(self.cuts))
        data = [self.value[self.cuts[b] : self.cuts[b + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for b in some]
        return _fragments(some, pid, data)

    def alive(self, bits: dict[int, bytes]) -> np.ndarray:
        """For every sample, whether its string recurs: in another block, or in another document of this one."""
        told = np.zeros(len(self.value), bool)
        for b, data in bits.items():
            n = self.cuts[b + 1] - self.cuts[b]
            told[self.cuts[b] : self.cuts[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n)
        low, high = np.zeros(len(self.value), np.int32), np.zeros(len(self.value), np.int32)
        low[self.where[::-1]], high[self.where] = self.rank[::-1], self.rank
        out = np.zeros(len(self.fits), bool)
        out[self.fits] = (told | (high > low))[self.where]
        return out


class Pieces:
    """The block's open suffixes as pieces of text: runs of suffixes with one anchor, each distinct text once."""

    def __init__(self, block: Block, alive: np.ndarray, buckets: int):
        at = block.samples[alive]
        row = block.row_of_cell[at // PERIOD]
        low, high = np.maximum(at - PERIOD + 1, block.start[row]), np.minimum(at, block.end[row] - MATCH) + 1
        n = len(block.bytes)
        self.open = np.flatnonzero(_starts(low[high > low], high[high > low], n))
        if not len(self.open):
            self.first, self.count, self.piece, self.rank = (np.zeros(0, np.int64),) * 4
            self.texts, self.first_rank, self.bucket = [], np.zeros(0, np.int32), np.zeros(0, np.int64)
            return
        # hash of the leading bytes, place in the low half: the least is the leftmost of the smallest
        m = len(block.words) - ANCHOR
        mixed = mix64(block.words[:m] ^ mix64(block.words[ANCHOR - 8 : m + ANCHOR - 8]))
        least = (mixed >> np.uint64(32) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
        width, reach = MATCH - ANCHOR + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        anchor = np.minimum(least[self.open], least[self.open + width - reach]).astype(np.uint32).astype(np.int64)
        new = np.ones(len(self.open), bool)
        new[1:] = (self.open[1:] != self.open[:-1] + 1) | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(new)
        self.first, self.count = self.open[begin], np.diff(np.append(begin, len(self.open)))
        self.rank = block.rank[block.row_of_cell[self.first // PERIOD]]
        raw, seen = block.bytes.tobytes(), {}
        self.piece = np.array([seen.setdefault(raw[a : a + c + MATCH - 1], len(seen)) for a, c in zip(self.first.tolist(), self.count.tolist(), strict=True)], np.int64)
        self.texts = list(seen)
        places = np.zeros(len(seen), np.int64)
        places[self.piece[::-1]] = np.arange(len(self.piece))[::-1]  # the first run of each text
        self.first_rank = self.rank[places].astype(np.int32)
        self.bucket = (mix64(mixed[anchor[begin[places]]]) >> np.uint64(32)).astype(np.int64) * buckets >> 32

    def by_bucket(self) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(self.bucket, kind="stable")
        some, begin = np.unique(self.bucket[order], return_index=True)
        return list(zip(some.tolist(), np.split(order, begin[1:]), strict=True)) if len(order) else []

    def fragments(self, pid: int) -> pa.Table:
        """One row per bucket: number of pieces, their lengths, first ranks and texts."""
        names, data = [], []
        for b, which in self.by_bucket():
            names.append(b)
            texts = [self.texts[i] for i in which]
            data.append(np.uint32(len(which)).tobytes() + np.array([len(t) for t in texts], np.uint16).tobytes() + self.first_rank[which].tobytes() + b"".join(texts))
        return _fragments(names, pid, data)

    def matched(self, bits: dict[int, bytes]) -> np.ndarray:
        """The open suffixes that an earlier document has: by the bit of the piece, or because an earlier document of
        this block has the whole piece."""
        size = np.array([len(t) - MATCH + 1 for t in self.texts], np.int64)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        told = np.zeros(start[-1], bool)
        for b, which in self.by_bucket():
            mine = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(size[which].sum())).astype(bool)
            told[_ranges(start[which], size[which])] = mine
        out = told[_ranges(start[self.piece], self.count)]
        out |= np.repeat(self.rank > self.first_rank[self.piece] if len(self.piece) else np.zeros(0, bool), self.count)
        return self.open[out]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every range, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _fragments(buckets, pid: int, data: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "pid": pa.array([pid] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


class Told:
    """What a block has been told: answers of the last round by bucket, and the state it left for itself."""

    def __init__(self, table: pa.Table):
        self.answers: dict[int, bytes] = dict(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True))
        self.state = self.answers.pop(-1, b"")

    def marks(self, n: int, which: int) -> np.ndarray:
        """The ``which``-th bit list of length ``n`` of the state."""
        size = -(-n // 8)
        return np.unpackbits(np.frombuffer(self.state, np.uint8)[which * size : (which + 1) * size], count=n).astype(bool)


def _state(pid: int, *marks: np.ndarray) -> pa.Table:
    """A fragment to a bucket of its own, which hands it back: bit lists over the block's samples."""
    data = b"".join(np.packbits(m).tobytes() for m in marks)
    return pa.table({"bucket": pa.array([-1 - pid], pa.int32()), "pid": pa.array([pid], pa.int32()), "data": pa.array([data], pa.binary())})


def ask_recurring(block: Block, told: Told, sizes: tuple[int, int], pid: int) -> list[pa.Table]:
    """Round 0: which sample strings does another block have?"""
    return [Fingerprints(block, sizes[0]).fragments(pid)]


def ask_earlier(block: Block, told: Told, sizes: tuple[int, int], pid: int) -> list[pa.Table]:
    """Round 1: which suffixes near a recurring sample does an earlier document have?"""
    alive = Fingerprints(block, sizes[0]).alive(told.answers)
    return [Pieces(block, alive, sizes[1]).fragments(pid), _state(pid, alive)]


def sort_fingerprints(parts: list[bytes]) -> list[np.ndarray]:
    """For every fingerprint of every block (distinct in each), whether another block has it."""
    keys = [np.frombuffer(p, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for p in parts]
    ordered = np.sort(np.concatenate(keys))
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return [np.zeros(len(k), bool) for k in keys]
    return [twice[np.minimum(np.searchsorted(twice, k), len(twice) - 1)] == k for k in keys]


def fingerprint(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit mix of the MATCH bytes, given as words."""
    out = np.full(len(columns[0]), STEP, np.uint64)
    for c in columns:
        out ^= c
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix64(out)


def earlier(columns: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """For each suffix (its bytes as words), whether a smaller ``doc`` has the same bytes.

    Sorted by fingerprint, then compared as bytes inside each run; if any two of one fingerprint differ, all are sorted
    by their bytes instead.
    """
    key = fingerprint(columns)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    again = np.flatnonzero(~new)
    if any((c[order[again]] != c[order[again - 1]]).any() for c in columns):
        order = np.lexsort(columns[::-1])
        new[1:] = False
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], starts) if len(starts) else doc
    hit = np.empty(len(order), bool)
    hit[order] = doc[order] > least[np.cumsum(new) - 1]
    return hit


def sort_suffixes(parts: list[bytes]) -> list[np.ndarray]:
    """Sort the suffixes of one bucket, blocks in order, and compare them as bytes; for every one, whether an earlier
    document has it. Pieces of one text are one: the later ones follow the first."""
    seen: dict[bytes, int] = {}
    texts, docs, counts, at = [], [], [], 0
    for p in parts:
        n = int(np.frombuffer(p[:4], np.uint32)[0])
        lengths, ranks = np.frombuffer(p, np.uint16, n, 4).astype(np.int64), np.frombuffer(p, np.int32, n, 4 + 2 * n)
        # documents in order: blocks in order, ranks inside a block
        names, own = np.unique(ranks, return_inverse=True)
        docs.append(own + at)
        at += len(names)
        ends = (4 + 6 * n + np.cumsum(lengths)).tolist()
        texts.append([seen.setdefault(p[e - z : e], len(seen)) for e, z in zip(ends, lengths.tolist(), strict=True)])
        counts.append(int((lengths - MATCH + 1).sum()))
    which, doc = np.concatenate(texts).astype(np.int64), np.concatenate(docs).astype(np.int32)
    first = np.full(len(seen), np.iinfo(np.int32).max, np.int32)
    np.minimum.at(first, which, doc)
    length = np.array([len(t) for t in seen], np.int64)
    text = np.frombuffer(b"".join(seen) + bytes(8), np.uint8)
    count = length - MATCH + 1
    start = np.cumsum(count) - count
    place = _ranges(np.cumsum(length) - length, count)
    words = np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))
    columns = [words[place + o].astype(np.uint64) for o in (*range(0, MATCH - 8, 8), MATCH - 8)]
    hit = earlier(columns, np.repeat(first, count))
    every = hit[_ranges(start[which], count[which])] | np.repeat(doc > first[which], count[which])
    return np.split(every, np.cumsum(counts)[:-1])


def _bucket_answers(sort):
    """Sort one bucket and answer every block that has something in it."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # a block's own state
            return pa.table({"pid": table.column("pid"), "bucket": pa.array([-1] * table.num_rows, pa.int32()), "data": table.column("data")})
        pid = table.column("pid").to_numpy()
        order = np.argsort(pid, kind="stable")
        raw = table.column("data").combine_chunks()
        bits = [np.packbits(h).tobytes() for h in sort([raw[int(i)].as_py() for i in order])]
        return pa.table({"pid": pa.array(pid[order], pa.int32()), "bucket": pa.array([bucket] * len(order), pa.int32()), "data": pa.array(bits, pa.binary())})

    return run


def _asker(ask, sizes: tuple[int, int]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _fragments([], 0, [])
        return pa.concat_tables(ask(Block(docs), Told(answers), sizes, docs.column("pid")[0].as_py()))

    return run


def _finisher(sizes: tuple[int, int]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block, told = Block(docs), Told(answers)
        at = Pieces(block, told.marks(len(block.samples), 0), sizes[1]).matched(told.answers)
        rows: list[tuple] = []
        cut = np.searchsorted(at, np.append(block.start, len(block.bytes)))
        for r, doc in enumerate(block.ids):
            s, size = block.start[r], int(block.size[r])
            text = block.bytes[s : s + size]
            mine = at[cut[r] : cut[r + 1]] - s
            gone = _starts(mine, mine + MATCH, size) if len(mine) else np.zeros(size, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            rows.append((doc, size, int(gone.sum()), len(edge) // 2, hashlib.sha256(text[~gone].tobytes()).hexdigest(), edge.tolist()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def _tidy1(run):
    return lambda t: tidy_group(run, t)


def _tidy2(run):
    return lambda a, b: tidy_group(run, a, b)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """Spans of every whole text (UTF-8 bytes) that start in an earlier document too.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (flat list of
    start and end of each maximal removed run, in bytes).

    Nulls and edges: a null text is empty; texts under 50 bytes lose nothing; rows without id come after all
    others, each distinct text as a document of its own, in order of a hash; rows that repeat an id are one document and
    do not match each other, but both match earlier ids; other columns are ignored; an empty table gives an empty table.
    A single document, and the rows of one id together, must fit a worker's memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    doc_id = F.col(id_col).cast("bigint")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text_col).alias("text"), F.when(doc_id.isNull(), F.xxhash64(F.col(text_col))).otherwise(F.lit(0)).alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, -(-int(total) // block_bytes))
    sizes = (max(1, -(-int(total) // SAMPLE_BUCKET)), max(1, -(-int(total) // BUCKET)))
    parts = min(n, PARTITIONS)
    dealt = rows.withColumn("rid", F.monotonically_increasing_id()).repartitionByRange(n, F.col("doc_id").asc_nulls_last(), "tie")
    blocks = scratch.bucketed(dealt.withColumn("pid", F.spark_partition_id()), "blocks", "pid", parts, dealt=True)
    scratch.release()
    answers = scratch.bucketed(spark.createDataFrame([], ANSWERS), "answers_none", "pid", parts)
    for rnd, (ask, sort) in enumerate(((ask_recurring, sort_fingerprints), (ask_earlier, sort_suffixes))):
        asked = blocks.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_tidy2(_asker(ask, sizes)), FRAGMENTS)
        # about a bucket a task, however many there are
        met = asked.repartition(min(PARTITIONS, max(least, sizes[rnd])), "bucket")
        told = met.groupBy("bucket").applyInArrow(_tidy1(_bucket_answers(sort)), ANSWERS)
        fresh = scratch.bucketed(told, f"answers_{rnd}", "pid", parts)
        scratch.drop(f"answers_{rnd - 1}" if rnd else "answers_none")
        answers = fresh
        del asked, met, told
        scratch.release()
    out = scratch.keep(blocks.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_tidy2(_finisher(sizes)), RESULT), "result")
    del blocks, answers
    scratch.drop("blocks", "answers_1")
    return out
