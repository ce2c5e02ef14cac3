"""Best-fit packing of tokenised documents into fixed-length sequences.

Bulk-synchronous best fit. Pieces are dealt to length classes (``class_bounds``), longest class first. A superstep
range-sorts the open pieces of its class together with the gaps that can hold one of them, by size, and sweeps the
order downwards: a gap puts its slots on a stack, a piece takes the slot on top, which is in the smallest gap that
holds it (its successor). Every range sweeps alone; what a range leaves over (pieces without a slot, slots without
a piece) is settled by rank from one summary row a range, because leftover pieces of a range always take the last
leftover slots of the ranges before. Then the gaps are updated, and the superstep is repeated with the pieces that
are left; those that no gap holds open sequences, in order of their rank over all ranges. Ties of size have one order,
by hash, in every range and superstep, so the packing does not depend on where ranges end; a class that is one range
runs the same supersteps in its one task, row for row with the same outcome (tests compare). Counts by size, before and
after a superstep (at most half of ``capacity`` squared numbers), only decide which gaps a superstep has to look at, and
when a class is done.

Within a class a gap offers as many slots as it holds pieces of the class's largest length present, so a class of one
length is exact best-fit-decreasing, as are the classes above a third of the capacity; the others come close to it
(tests compare; with some 40 supersteps it needs as many sequences, give or take a few in 100,000).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.llm.tokens import encoder
from voxelweave.scratch import Scratch

#: Pieces and slots that one range of a sweep holds, on average.
RANGE_ROWS = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter than ``capacity``."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts (null: empty), append ``end_id`` and cut; one row per piece."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                rows += [(doc, k, s, m, zlib.crc32(ids[s : s + m].tobytes())) for k, (s, m) in enumerate(pieces_of(len(ids), capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def class_bounds(capacity: int) -> list[tuple[int, int]]:
    """``(lo, hi]`` of the length classes, longest first: between capacity/k for k up to 4, then 10 % apart down to
    a sixteenth of the capacity, then 50 % apart."""
    out, hi = [], capacity
    for k in range(2, 5):
        if capacity // k < hi:
            out.append((capacity // k, hi))
            hi = capacity // k
    while hi > 0:
        lo = min(hi - 1, int(hi / (1.1 if hi > capacity // 16 else 1.5)))
        out.append((lo, hi))
        hi = lo
    return out


def sweep_range(size: np.ndarray, is_piece: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sweep rows that are sorted by size, largest first, gaps before pieces of their size.

    Returns for each row: the row of the gap that a piece goes to (-1: none); the stack level (from 0) of a gap's
    first slot; the number of a gap's slots that are left. Left slots fill the levels from 0 without holes.
    """
    n = len(size)
    row = np.repeat(np.arange(n), np.where(is_piece, 1, slots))
    piece = is_piece[row]
    height = np.cumsum(np.where(piece, -1, 1))
    floor = np.minimum.accumulate(np.minimum(height, 0))
    before = np.concatenate([[0], floor[:-1]])
    lost = piece & (height < before)  # the stack was empty
    level = height - floor + np.where(piece, 1, 0)
    events = np.flatnonzero(~lost)
    # on each level, slots and pieces take turns; a piece takes the slot before it
    order = events[np.argsort(level[events], kind="stable")]
    taken = np.flatnonzero(piece[order])
    to = np.full(n, -1)
    to[row[order[taken]]] = row[order[taken - 1]]
    used = np.zeros(len(row), bool)
    used[order[taken - 1]] = True
    left = np.bincount(row[~piece & ~used], minlength=n)
    first = np.zeros(n, np.int64)
    starts = np.flatnonzero(~piece & np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    first[row[starts]] = level[starts] - 1
    return to, first, left


def finish_range(size: np.ndarray, is_piece: np.ndarray, ident: np.ndarray, tie: np.ndarray, hi: int, capacity: int) -> tuple[np.ndarray, dict[int, int]]:
    """Supersteps of a class that is one range, up to its end: sequence of each row's piece, and what each sequence takes.

    Rows as in ``sweep_range``; ``ident`` is a gap's sequence, or a piece's number, which is the sequence's if it opens
    one; ``tie`` orders equal sizes. The outcome is that of the same supersteps over many ranges, row by row.
    """
    rank = dict(zip(ident[~is_piece].tolist(), tie[~is_piece].tolist(), strict=True))
    seq = np.where(is_piece, -1, ident)
    gap = dict(zip(ident[~is_piece].tolist(), size[~is_piece].tolist(), strict=True))
    load: dict[int, int] = dict.fromkeys(gap, 0)
    while True:
        todo = np.flatnonzero(is_piece & (seq < 0))
        if not len(todo):
            return seq, load
        open_gaps = np.array([(g - load[s], s) for s, g in gap.items() if g - load[s] >= size[todo].min()], np.int64).reshape(-1, 2)
        if not len(open_gaps):
            # nothing holds what is left: so many of the class as always fit share a sequence
            first = todo[np.arange(len(todo)) // (capacity // hi) * (capacity // hi)]
            seq[todo] = ident[first]
            for s, n in zip(ident[first].tolist(), size[todo].tolist(), strict=True):
                load[s] = load.get(s, 0) + n
            return seq, load
        sizes = np.concatenate([open_gaps[:, 0], size[todo]])
        piece = np.arange(len(sizes)) >= len(open_gaps)
        names = np.concatenate([open_gaps[:, 1], todo])
        ties = np.concatenate([np.array([rank[s] for s in open_gaps[:, 1].tolist()], np.int64), tie[todo]])
        order = np.lexsort((names, ties, piece, -sizes))
        to, _, _ = sweep_range(sizes[order], piece[order], np.maximum(1, sizes[order] // hi))
        goes = np.flatnonzero(to >= 0)
        rows, into = names[order[goes]], names[order[to[goes]]]
        seq[rows] = into
        for s, n in zip(into.tolist(), size[rows].tolist(), strict=True):
            load[s] += n


def carry_runs(summary: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Match what ranges leave over. ``summary``: ``(range, pieces, slots)``, largest sizes first.

    Returns runs ``(range, rank, count, of, top)``: the range's leftover pieces ``rank`` to ``rank + count - 1``
    take the leftover slots ``top``, ``top - 1``, ... of the range ``of``.
    """
    stack: list[list[int]] = []
    runs = []
    for p, pieces, slots in sorted(summary):
        rank = 0
        while rank < pieces and stack:
            of, n = stack[-1]
            take = min(n, pieces - rank)
            runs.append((p, rank, take, of, n - 1))
            rank += take
            stack[-1][1] -= take
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([p, slots])
    return runs


class _Supersteps:
    """State of one packing: the gap tables, their counts by size, and the tables of placed pieces.

    A superstep reads some gaps and writes them anew; the tables that hold their old rows get a condition that
    leaves those out, and every ``MERGE`` supersteps the tables are merged.
    """

    MERGE = 6

    def __init__(self, scratch: Scratch, columns: list[str], capacity: int, range_rows: int):
        self.scratch, self.spark, self.columns, self.capacity, self.range_rows = scratch, scratch.spark, columns, capacity, range_rows
        self.gaps: list[DataFrame] = []
        self.sizes: dict[int, int] = {}
        self.placed: list[DataFrame] = []
        self.step = 0

    def gap_table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.gaps) if self.gaps else self.spark.createDataFrame([], "seq_ bigint, gap_ int")

    def add_gaps(self, table: DataFrame, counts: dict[int, int]) -> None:
        """Add a table of gaps (``seq_, gap_``) with its counts by size."""
        for size, n in counts.items():
            if size > 0:
                self.sizes[size] = self.sizes.get(size, 0) + n
        self.gaps.append(table.where("gap_ > 0").select("seq_", F.col("gap_").cast("int").alias("gap_")))
        if len(self.gaps) > self.MERGE:
            rows = sum(self.sizes.values())
            self.gaps = [self.scratch.keep(self.gap_table().coalesce(max(1, -(-rows // (8 * self.range_rows)))), f"gaps_{self.step}")]

    def open_each(self, pieces: DataFrame, counts: dict[int, int]) -> None:
        """Every piece opens a sequence; its own number is the sequence's."""
        opened = pieces.withColumn("seq_", F.col("rid_"))
        self.placed.append(opened)
        self.add_gaps(opened.select("seq_", (F.lit(self.capacity) - F.col("length")).alias("gap_")), {self.capacity - size: n for size, n in counts.items()})

    def choose(self, lo: int, hi: int, n: int) -> tuple[F.Column, int, bool]:
        """Which gaps a sweep of ``n`` pieces in (lo, hi] has to see; with their slots, and whether some are left out.

        All that hold a piece, in order of size, until there are slots for every piece; of the last size, a part
        by hash if it has far more than are needed (gaps of one size are alike).
        """
        have, total, top, share = 0, 0, 0, 1.0
        for size in sorted(s for s in self.sizes if s > lo):
            slots, count = max(1, size // hi), self.sizes[size]
            top = size
            if size >= hi:
                need = n - have
                if slots * count > 3 * need + 3000 * slots:
                    share = max(1.5 * need / (slots * count), 1500 / count)
                    total += int(share * count * slots)
                    break
                have += slots * count
            total += slots * count
            if have >= n:
                break
        keep = (F.col("gap_") > lo) & (F.col("gap_") <= top)
        if share < 1:
            keep &= (F.col("gap_") < top) | (F.pmod(F.xxhash64("seq_"), F.lit(1 << 30)) < int(share * (1 << 30)))
        return keep, total, share < 1

    def sweep(self, pieces: DataFrame, lo: int, hi: int, n: int) -> tuple[DataFrame | None, int]:
        """One superstep over ``n`` pieces of (lo, hi]; returns the pieces that are left, and their number."""
        self.step += 1
        keep, slots, partial = self.choose(lo, hi, n)
        ranges = max(1, -(-(n + slots) // self.range_rows))
        names, schema = self.columns, pieces.schema
        none = [F.lit(None).cast(schema[c].dataType).alias(c) for c in (*names, "rid_")]
        items = pieces.select(F.col("length").cast("int").alias("size_"), F.lit(True).alias("piece_"), F.lit(None).cast("bigint").alias("seq_"), *names, "rid_").unionByName(
            self.gap_table().where(keep).select(F.col("gap_").alias("size_"), F.lit(False).alias("piece_"), "seq_", *none)
        )
        items = items.withColumn("tie_", F.xxhash64("rid_", "seq_"))
        key = [F.col("size_").desc(), F.col("piece_").asc(), F.col("tie_").asc(), F.coalesce("rid_", "seq_").asc()]
        dealt = items.repartitionByRange(ranges, *key) if ranges > 1 else items.coalesce(1)
        alone = ranges == 1 and not partial
        swept = self.scratch.keep(dealt.mapInArrow(_sweeper(hi, self.capacity if alone else None), _swept_schema(items)), f"sweep_{self.step}")
        lost, gap = F.col("piece_") & F.col("seq_").isNull(), F.col("size_") - F.col("load_")
        # counts by size; by range, too, if there is more than one
        by_size = swept.groupBy("piece_", lost.alias("lost_"), "size_", gap.alias("gap_"), (F.col("rank_") < 0).alias("new_")).agg(F.count("*").alias("n"), F.max("pid_").alias("pid_"), F.sum("left_").alias("s")).collect()
        left, done = sum(r["n"] for r in by_size if r["lost_"]), sum(r["n"] for r in by_size if r["piece_"] and not r["lost_"])
        summary = [(0, left, 0)]
        if ranges > 1 and left:
            summary = [tuple(r) for r in swept.groupBy("pid_").agg(F.count_if(lost), F.sum("left_")).collect()]
        docs = swept.where("piece_").select(*names, "rid_", "seq_", "pid_", "rank_")
        self.placed.append(docs.where("seq_ IS NOT NULL").select(*names, "rid_", "seq_"))
        open_docs = docs.where("seq_ IS NULL")
        after = swept.where("NOT piece_").select("seq_", gap.alias("gap_"), "pid_", "first_", "left_")
        fresh: dict[int, int] = {}
        for r in by_size:
            if not r["piece_"]:
                if not r["new_"]:
                    self.sizes[r["size_"]] -= r["n"]
                fresh[r["gap_"]] = fresh.get(r["gap_"], 0) + r["n"]
        self.sizes = {size: k for size, k in self.sizes.items() if k}
        self.gaps = [g.where(~keep) for g in self.gaps]
        runs = carry_runs(summary) if left and len(summary) > 1 else []
        if runs:
            table = self.spark.createDataFrame(runs, "p_ int, lo_ bigint, n_ bigint, of_ int, top_ bigint")
            asked = open_docs.join(F.broadcast(table), (F.col("pid_") == F.col("p_")) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("lo_") + F.col("n_")), "left")
            asked = asked.select(*names, "rid_", "pid_", "rank_", F.col("of_"), (F.col("top_") - (F.col("rank_") - F.col("lo_"))).alias("slot_"))
            # of a gap's left slots, those that some run takes
            wanted = after.where("left_ > 0").join(F.broadcast(table), (F.col("pid_") == F.col("of_")) & (F.col("first_") <= F.col("top_")) & (F.col("first_") + F.col("left_") > F.col("top_") - F.col("n_") + 1))
            slot = F.explode(F.sequence(F.greatest("first_", F.col("top_") - F.col("n_") + 1), F.least(F.col("first_") + F.col("left_") - 1, "top_")))
            given = wanted.select(F.col("seq_").alias("to_"), F.col("of_").alias("o_"), slot.alias("s_"))
            carried = asked.join(given, (F.col("of_") == F.col("o_")) & (F.col("slot_") == F.col("s_")), "left").select(*names, "rid_", F.col("to_").alias("seq_"), "pid_", "rank_")
            carried = self.scratch.keep(carried, f"carried_{self.step}")
            self.placed.append(carried.where("seq_ IS NOT NULL").select(*names, "rid_", "seq_"))
            open_docs = carried.where("seq_ IS NULL")
            load = carried.where("seq_ IS NOT NULL").groupBy(F.col("seq_").alias("to_")).agg(F.sum("length").alias("more_"))
            after = after.join(load, F.col("seq_") == F.col("to_"), "left").withColumn("gap_", F.col("gap_") - F.coalesce("more_", F.lit(0)))
            after = self.scratch.keep(after, f"after_{self.step}")
            fresh = dict(map(tuple, after.groupBy("gap_").agg(F.count("*")).collect()))
            moved = sum(r[2] for r in runs)
            left, done = left - moved, done + moved
        self.add_gaps(after.select("seq_", "gap_"), {int(k): int(v) for k, v in fresh.items()})
        if not left:
            return None, 0
        # the smallest piece that is left may have been carried; then the next superstep finds nothing to do and opens
        least = min(r["size_"] for r in by_size if r["lost_"])
        if (done or partial) and max(self.sizes, default=0) >= least:
            return open_docs.select(*names, "rid_"), left
        # what is left of a range are its last pieces in rank; the pieces left in ranges before it come first
        carried_off: dict[int, int] = {}
        for p, _, count, _, _ in runs:
            carried_off[p] = carried_off.get(p, 0) + count
        shifts, before = [], 0
        for p, lost_here, _ in sorted(summary):
            shifts.append((int(p), before - carried_off.get(p, 0)))
            before += lost_here - carried_off.get(p, 0)
        shift = self.spark.createDataFrame(shifts, "p_ int, shift_ bigint")
        place = F.floor((F.col("rank_") + F.col("shift_")) / (self.capacity // hi))
        group = W.partitionBy("group_").orderBy("pid_", "rank_")
        spread = open_docs.join(F.broadcast(shift), F.col("pid_") == F.col("p_")).withColumn("group_", place).withColumn("seq_", F.first("rid_").over(group))
        opened = self.scratch.keep(spread.select(*names, "rid_", "seq_"), f"opened_{self.step}")
        self.placed.append(opened)
        made = self.scratch.keep(opened.groupBy("seq_").agg((F.lit(self.capacity) - F.sum("length")).cast("int").alias("gap_")), f"made_{self.step}")
        self.add_gaps(made, dict(map(tuple, made.groupBy("gap_").agg(F.count("*")).collect())))
        return None, 0


def _swept_schema(items: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", pid_ int, rank_ bigint, first_ bigint, left_ bigint, load_ bigint"


def _sweeper(hi: int, capacity: int | None):
    """Sweep one range; with ``capacity``, the range is all there is and is swept and opened to its end."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        size, piece = t.column("size_").to_numpy(), t.column("piece_").to_numpy()
        ident = np.where(piece, t.column("rid_").fill_null(0).to_numpy(), t.column("seq_").fill_null(0).to_numpy())
        tie = t.column("tie_").to_numpy()
        order = np.lexsort((ident, tie, piece, -size))
        t, size, piece, ident, tie = t.take(pa.array(order)), size[order], piece[order], ident[order], tie[order]
        n = len(size)
        if capacity is None:
            to, first, left = sweep_range(size, piece, np.maximum(1, size // hi))
            goes = to >= 0
            seq = np.where(piece, -1, ident)
            seq[goes] = ident[to[goes]]
            rank = np.maximum(np.cumsum(piece & ~goes) - 1, 0)
            load = np.bincount(to[goes], size[goes], n).astype(np.int64)
        else:
            seq, taken = finish_range(size, piece, ident, tie, hi, capacity)
            first = left = rank = np.zeros(n, np.int64)
            load = np.array([0 if p else taken.pop(s) for p, s in zip(piece.tolist(), seq.tolist(), strict=True)], np.int64)
        t = t.set_column(t.schema.get_field_index("seq_"), "seq_", pa.array(seq, pa.int64(), mask=seq < 0))
        for name, values, kind in (("pid_", np.full(n, TaskContext.get().partitionId()), pa.int32()), ("rank_", rank, pa.int64()), ("first_", first, pa.int64()), ("left_", left, pa.int64()), ("load_", load, pa.int64())):
            t = t.append_column(name, pa.array(values, kind))
        yield from t.combine_chunks().to_batches(1 << 16)
        if capacity is not None and taken:  # sequences that were opened here: gaps with rank -1
            made = {"size_": [capacity] * len(taken), "piece_": [False] * len(taken), "seq_": list(taken), "pid_": [0] * len(taken), "rank_": [-1] * len(taken), "first_": [0] * len(taken), "left_": [0] * len(taken), "load_": list(taken.values())}
            yield pa.RecordBatch.from_arrays([pa.array(made.get(f.name, [None] * len(taken)), f.type) for f in t.schema], schema=t.schema)

    return run


def pack(pieces: DataFrame, capacity: int = 1024, scratch: Scratch | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Give every piece (``doc_id, piece, length``, other columns stay) a ``sequence_id`` and an ``offset``.

    Lengths are between 1 and ``capacity``, else ``ValueError``. Repeated rows are pieces of their own; ties of
    length are in a fixed order of the written rows; an empty table gives an empty table. ``sequence_id`` is the
    row number of a sequence's first piece. No range holds more than about ``range_rows`` pieces and slots, also
    where one length has most pieces, since ranges cut through a length. The driver sees counts by size and one
    summary row a range.
    """
    scratch = scratch or Scratch(pieces.sparkSession, "pack")
    spark, names = scratch.spark, pieces.columns
    bounds = class_bounds(capacity)
    number = reduce(lambda a, b: a + b, [(F.col("length") <= lo).cast("int") for lo, _ in bounds])
    pieces.withColumns({"rid_": F.monotonically_increasing_id(), "class_": number}).write.partitionBy("class_").parquet(scratch.path("dealt"))
    schema = pieces.withColumn("rid_", F.lit(0).cast("bigint")).schema
    every = spark.read.schema(pieces.select("length").withColumn("class_", F.lit(0)).schema).parquet(scratch.path("dealt"))
    counts = {int(r[0]): int(r[1]) for r in every.groupBy("length").agg(F.count("*")).collect()}
    if counts and not (1 <= min(counts) and max(counts) <= capacity):
        raise ValueError("a piece must have 1 to `capacity` tokens")
    state = _Supersteps(scratch, names, capacity, range_rows)
    for c, (lo, hi) in enumerate(bounds):
        sizes = [size for size in counts if lo < size <= hi]
        if not sizes:
            continue
        n, hi = sum(counts[size] for size in sizes), max(sizes)
        left = spark.read.schema(schema).parquet(scratch.path(f"dealt/class_={c}"))
        if capacity // hi < 2 and not state.sizes:
            state.open_each(left, {size: counts[size] for size in sizes})
            continue
        while left is not None:
            left, n = state.sweep(left, lo, hi, n)
    if not state.placed:
        state.placed.append(spark.createDataFrame([], schema).withColumn("seq_", F.lit(0).cast("bigint")))
    placed = reduce(DataFrame.unionByName, state.placed)
    before = W.partitionBy("seq_").orderBy(F.col("length").desc(), "rid_").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*names, F.col("seq_").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenise and pack whole documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end token alone; a repeated row is packed again; a null id stays null; other
    columns are ignored; an empty table gives an empty table. Token pieces are written to the shared folder
    once, so nothing is tokenised twice and a lost executor costs a re-read.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.keep(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
