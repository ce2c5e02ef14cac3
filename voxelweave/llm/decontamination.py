"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Symbols are words (runs of letters and digits, lower-cased); a document leaks an item of m words if some window of it
is within floor((1 - similarity) * m) word edits.

* **Windows.** Items are grouped by size class, the largest power of two w <= m. A document has a window at every word
  (stride 1); an item gives a window at every w/32-th of its words, as long as the sampled walk stays inside the item.
* **Embedding.** The CGK walk reads the window's word at step t and moves on if the shared random bit of (t, word) says
  so, which maps edit distance to Hamming distance. The bits have a period of ``PERIOD`` steps, so that the walks of all
  windows of a text are compositions of one table (where is a walk ``PERIOD`` steps on?), and the place of any walk at
  step t costs a logarithmic number of look-ups instead of t steps. A walk moves on at least once a period.
* **Bit sampling.** A class has ``REPEATS`` samples of ``BITS`` steps, drawn from the first ``REACH`` * w steps (the part
  of the walk before edits have driven two walks far apart), one from each half of it, so that they see different words. The sampled symbol is the word with its successor. The samples' hash is the bucket key; item windows
  are a table of keys, and document windows look theirs up.
* **Verification.** A window of an item's bucket that has enough of its words is verified by bit-parallel edit distance
  with free ends, so all that is reported is exact; what can be lost is a leak that agrees in no sample (the tests
  measure it: recall 0.995 at 20 % edits on texts of the check tables, 1.000 at 5 and 10 %).

Items of fewer than ``SHORT`` words have no walk to sample: their windows are the pieces of which one edit less than
their number leaves one intact (no loss). An item of one to four words has to occur exactly, so a one-word item
condemns every document with that word: leave such items out where that is not meant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.llm.text import BASE, mix64, segments, slices, span_hashes, string_view
from voxelweave.llm.toxicity import FOLD, LETTER
from voxelweave.scratch import Scratch

BITS, REPEATS, PERIOD, REACH, SHORT = 2, 8, 8, 1.0, 8
#: Bytes of items handled at once (an index of under 100 MB); a larger benchmark takes several passes over the rows, each
#: written before the next.
ITEM_BYTES = 3 << 19
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the document number of each."""
    folded = FOLD[data]
    s, e, doc = segments(LETTER[folded], offsets)
    return span_hashes(folded, s, e), doc


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of runs of ``k`` symbols within a document."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + h[at + j]
    return at, mix64(out)


class Walks:
    """CGK walks from every word of a text: where each is after t steps, and the symbol it samples there."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        bits = np.append((mix64(h ^ _ODD[0]) >> np.uint64(56)).astype(np.uint8), np.uint8(0))
        at = np.arange(n + 1, dtype=np.int32)
        self.phase = [at]
        for t in range(PERIOD):
            at = at + ((bits[at] >> np.uint8(t)) & np.uint8(1))
            self.phase.append(at)
        on = np.minimum(np.maximum(self.phase.pop(), self.phase[0] + 1), n).astype(np.int32)
        self.jump = [on]  # 2**i periods on
        pair = np.zeros(n + 1, np.uint64)
        pair[:n] = h * np.uint64(BASE)
        pair[: max(n - 1, 0)] += h[1:]
        self.pair = mix64(pair)
        self.small = (self.pair >> np.uint64(32)).astype(np.uint32)

    def places(self, steps: list[int]) -> dict[int, np.ndarray]:
        """Word at which every walk is at each of the steps."""
        out, at, done = {}, self.phase[0], 0
        for t in sorted(set(steps)):
            todo, i = t // PERIOD - done, 0
            while todo:
                while len(self.jump) <= i:
                    self.jump.append(self.jump[-1][self.jump[-1]])
                if todo & 1:
                    at = self.jump[i][at]
                todo, i = todo >> 1, i + 1
            done = t // PERIOD
            out[t] = self.phase[t % PERIOD][at]
        return out


def sampled_steps(w: int) -> np.ndarray:
    """``REPEATS`` by ``BITS`` steps for windows of class ``w``: one from each part of the walk."""
    part = REACH * w / BITS
    draw = np.random.default_rng(w).random((REPEATS, BITS))
    return ((np.arange(BITS) + draw) * part).astype(np.int64)


def _key(pairs: list[np.ndarray], repeat: int) -> np.ndarray:
    x = np.full(len(pairs[0]), repeat + 1, np.uint64)
    for p in pairs:
        x = mix64(x * np.uint64(BASE) + p)
    return x


def _filter(small: list[np.ndarray], repeat: int) -> np.ndarray:
    """A quick 32-bit mix of the same symbols."""
    x = small[0] * np.uint32(0x9E3779B1)
    for p in small[1:]:
        x ^= x >> np.uint32(15)
        x += p
        x *= np.uint32(0x85EBCA77 + 2 * repeat)
    return x


def edit_distance(item: list[int], text: list[int]) -> int:
    """Least edits that turn ``item`` into some substring of ``text`` (bit-parallel, free ends)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, x in enumerate(item):
        peq[x] = peq.get(x, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for x in text:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


class Items:
    """Index of a bounded set of items: tables of keys, by size class, of their windows. Memory follows the items' length."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        self.hash, doc = symbols(data, np.cumsum([0, *map(len, raw)]))
        cut = np.searchsorted(doc, np.arange(len(ids) + 1))
        keep = [i for i in range(len(ids)) if cut[i + 1] > cut[i]]
        self.ids = [ids[i] for i in keep]
        self.start, self.size = cut[keep], cut[[i + 1 for i in keep]] - cut[keep]
        self.edits = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        # distinct words of each item, to see which candidates have enough of them
        owner = np.repeat(np.arange(len(keep)), self.size)
        mine = np.concatenate([self.hash[s : s + m] for s, m in zip(self.start, self.size, strict=True)]) if keep else np.zeros(0, np.uint64)
        self.words = np.unique(self._tied(owner, mine))
        self.distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), mine]), axis=1)[0].astype(np.int64), minlength=len(keep)) if keep else np.zeros(0, np.int64)
        tables: dict[tuple[bool, int], list[tuple[int, int, int, int]]] = {}
        for n, (s, m) in enumerate(zip(self.start.tolist(), self.size.tolist(), strict=True)):
            if m < SHORT:
                w = m // (int(self.edits[n]) + 1)
                at, keys = grams(self.hash[s : s + m], np.zeros(m, np.int64), w)
                tables.setdefault((False, w), []).extend((int(k), 0, n, int(o)) for o, k in zip(at, keys, strict=True) if o % w == 0)
                continue
            w = 1 << (m.bit_length() - 1)
            starts = np.arange(0, m - w // 2, max(1, w // 32))
            walks, steps = Walks(self.hash[s : s + m]), sampled_steps(w)
            at = walks.places(steps.ravel().tolist())
            for r in range(REPEATS):
                places = [at[int(t)][starts] for t in steps[r]]
                inside = np.all([p < m for p in places], axis=0)
                keys, quick = _key([walks.pair[p] for p in places], r), _filter([walks.small[p] for p in places], r)
                tables.setdefault((True, w), []).extend((int(k), int(q), n, int(o)) for k, q, o, ok in zip(keys, quick, starts, inside, strict=True) if ok)
        self.tables = {}
        for kind, rows in tables.items():
            rows.sort()
            shift = 32 - min(26, max(16, (32 * len(rows)).bit_length()))
            mark = np.zeros(1 << (32 - shift), bool)
            mark[np.array([r[1] for r in rows], np.int64) >> shift] = True
            self.tables[kind] = (np.array([r[0] for r in rows], np.uint64), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), mark, shift)

    @staticmethod
    def _tied(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix64(word + mix64(item.astype(np.uint64) ^ _ODD[1]))

    def candidates(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct ``(document, item, start)`` of windows that share a bucket with an item's window."""
        found: list[np.ndarray] = []

        def look_up(kind: tuple[bool, int], at: np.ndarray, keys: np.ndarray) -> None:
            table, item, offset, _, _ = self.tables[kind]
            lo, hi = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
            n = hi - lo
            if n.any():
                which = np.repeat(lo, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                where = np.repeat(at, n)
                found.append(np.stack([doc[where], item[which], where - offset[which]], 1))

        walks = Walks(h) if any(walked for walked, _ in self.tables) else None
        for kind, (_, _, _, mark, shift) in self.tables.items():
            walked, w = kind
            if not walked:
                look_up(kind, *grams(h, doc, w))
                continue
            steps = sampled_steps(w)
            place = walks.places(steps.ravel().tolist())
            small = {t: walks.small[p] for t, p in place.items()}
            for r in range(REPEATS):
                quick = _filter([small[int(t)] for t in steps[r]], r)
                at = np.flatnonzero(mark[quick[: len(h)] >> np.uint32(shift)])
                if len(at):
                    look_up(kind, at, _key([walks.pair[place[int(t)][at]] for t in steps[r]], r))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
        """``(item id, edits)`` of every item that each text leaks, by item id; edits are the least of the windows found."""
        found: list[dict[int, int]] = [{} for _ in range(len(offsets) - 1)]
        h, doc = symbols(data, offsets)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        c = self.candidates(h, doc)
        # starts that are close together are one stretch, verified once
        near = c[:, 2] // (self.edits[c[:, 1]] + 1)
        begins = np.flatnonzero(np.any(np.diff(np.column_stack([c[:, :2], near]), axis=0, prepend=-1), axis=1) if len(c) else np.zeros(0, bool))
        last = np.append(begins[1:], len(c)) - 1
        c, until = c[begins], c[last, 2] if len(c) else np.zeros(0, np.int64)
        at, budget = 0, 1 << 20  # words of windows looked at together
        ends = np.cumsum(self.size[c[:, 1]] + 3 * self.edits[c[:, 1]]) if len(c) else np.zeros(0, np.int64)
        while at < len(c):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + budget, "right")))
            (d, n, s), s_last = c[at:stop].T, until[at:stop]
            at = stop
            spare, size = self.edits[n], self.size[n]
            lo, hi = np.maximum(s - spare, first[d]), np.minimum(s_last + size + spare, first[d + 1])
            # every edit takes at most one distinct word of the item away
            long = hi - lo
            row = np.repeat(np.arange(len(d)), long)
            words = h[np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long) + np.repeat(lo, long)]
            tied = self._tied(n[row], words)
            spot = np.minimum(np.searchsorted(self.words, tied), len(self.words) - 1)
            ok = self.words[spot] == tied
            pairs = np.unique(row[ok] * len(self.words) + spot[ok]) // len(self.words)
            enough = np.bincount(pairs, minlength=len(d)) >= self.distinct[n] - spare
            for i in np.flatnonzero(enough):
                di, ni = int(d[i]), int(n[i])
                item = self.hash[self.start[ni] : self.start[ni] + self.size[ni]].tolist()
                e = edit_distance(item, h[lo[i] : hi[i]].tolist())
                if e <= spare[i]:
                    key = self.ids[ni]
                    found[di][key] = min(e, found[di].get(key, e))
        return [sorted(f.items()) for f in found]


def with_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, column: str = "leaks", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", item_bytes: int | None = None) -> DataFrame:
    """Add ``column``: array<struct<item_id, edits>> of the items that each row's text leaks; rows stay as they are.

    Null or empty texts and items leak nothing, and a text without words does not either; an item needs an id; items
    that repeat an id are each looked for; repeated rows get the same answer; a column of that name is replaced (choose
    another to keep it); empty tables give what they should (no rows, or empty lists). Texts and items may be of any
    length; an index takes some 300 bytes a word of its items. Items come to the executors in parts of at most about
    ``item_bytes`` (``ITEM_BYTES`` if not given; a longer item is a part of its own), one pass over the rows for each, written before the next.
    """
    bench = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "leaks")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(total) // (item_bytes or ITEM_BYTES)))
    out = docs.drop(column).withColumn(column, F.array().cast("array<struct<item_id: bigint, edits: int>>"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    place = out.columns.index(text_col)

    def scan(index: Items):
        @tidy_batches
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col, 1 << 18):
                got = index.leaks(*string_view(b.column(place)))
                before = b.column(b.num_columns - 1)
                if any(got):
                    lists = [[*(old.as_py() or ()), *({"item_id": i, "edits": e} for i, e in new)] for old, new in zip(before, got, strict=True)]
                    before = pa.array(lists, kind)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], before.cast(kind)], names=b.schema.names)

        return run

    for p in range(parts):
        rows = sorted(map(tuple, bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).distinct().collect()))
        out = out.mapInArrow(scan(Items([r[0] for r in rows], [r[1] for r in rows], similarity)), out.schema)
        if p < parts - 1:
            out = scratch.keep(out, f"pass_{p}")
            if p:
                scratch.drop(f"pass_{p - 1}")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, edits``, one row per document (see ``with_leaks``)."""
    rows = with_leaks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items, similarity)
    leaks = F.sort_array("leaks")
    return rows.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("bigint").alias("n_items"),
        F.transform(leaks, lambda x: x["item_id"]).alias("item_ids"), F.transform(leaks, lambda x: x["edits"]).alias("edits"),
    )
