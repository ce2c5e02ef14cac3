"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct ``k``-word shingles, each known by 128 bits. Documents with one set are one class and only its
smallest id goes on. One hash per shingle fills ``BINS`` bins with minima (one-permutation hashing); an empty
bin copies the bin that its own hash sequence reaches first (optimal densification), so small sets keep the
collision probability J in every bin. Bands of ``ROWS`` bins are bucket keys. Each bucket proposes a star
(its smallest id against the others), not its pairs; links are confirmed on full sets.

Completeness: a bucket is finished when all its members are in one component. In an unfinished bucket the
members outside its largest component (strangers) are compared with all its members. Buckets with one largest
component share this work: each component meets its strangers once, small companies as pairs, large ones in
blocks of at most 2 * ``BLOCK`` sets, one block pair a task, where a matrix product counts the intersections.
So stars lose nothing against comparing all pairs of a bucket, no task holds more than two blocks, and rows
are copied once a block, not once a pair. Two sets with J >= 0.8 share no band with probability
(1 - 0.8**ROWS)**BANDS < 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.memory import small_batches, tidy_batches, tidy_group
from voxelweave.llm.text import BASE, Words, mix64, per_doc_sets, slices, string_view
from voxelweave.operators.components import connected_components
from voxelweave.operators.ranks import numbered
from voxelweave.scratch import Scratch

ROWS, BANDS = 6, 42
BINS = ROWS * BANDS
#: Sets in a block, and sets of a company that is compared as pairs.
BLOCK, COMPANY = 256, 12
#: Rounds of new stars in larger companies.
STARS = 4
#: Classes up to which they are broadcast (48 bytes each); above, the join shuffles.
BROADCAST_CLASSES = 300_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _attempt(t: int) -> np.ndarray:
    """The bin that each bin's hash sequence names at attempt ``t`` (the same for all documents)."""
    return (mix64(np.arange(BINS, dtype=np.uint64) + np.uint64((t + 1) * 1_000_003)) % np.uint64(BINS)).astype(np.int64)


def signatures(docs: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Densified one-permutation minima, ``n`` by ``BINS``; rows without shingles stay ``EMPTY``."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    sig = np.full(n * BINS, EMPTY)
    np.minimum.at(sig, docs * BINS + bins, mix64(hashes) >> np.uint64(1))
    sig = sig.reshape(n, BINS)
    filled = sig != EMPTY
    row, col = np.nonzero(~filled & filled.any(1)[:, None])
    t = 0
    while len(row):
        donor = _attempt(t)[col]
        ok = filled[row, donor]
        sig[row[ok], col[ok]] = sig[row[ok], donor[ok]]
        row, col, t = row[~ok], col[~ok], t + 1
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, ``n`` by ``BANDS``; the band number is part of the key."""
    grouped = sig.reshape(len(sig), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        out = mix64(out * np.uint64(BASE) + grouped[:, :, r])
    return out.astype(np.int64)


def _digest(pairs: np.ndarray) -> bytes | None:
    return hashlib.blake2b(pairs.tobytes(), digest_size=16).digest() if len(pairs) else None


def signature_table(rows: DataFrame, k: int) -> DataFrame:
    """``doc_id, row_key, n_shingles, digest, keys`` for every row (``doc_id, text, row_key``); digest and keys are
    null for empty sets."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = per_doc_sets(Words(*string_view(b.column(1)), wide=True), k)
            size = np.array([len(s) for s in sets])
            keys = band_keys(signatures(np.repeat(np.arange(len(sets)), size), np.concatenate(sets)[:, 0], len(sets)))
            lists = pa.array([r if m else None for r, m in zip(keys, size, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(map(_digest, sets), pa.binary()), lists], names=["doc_id", "row_key", "n_shingles", "digest", "keys"])

    return rows.mapInArrow(run, "doc_id bigint, row_key string, n_shingles bigint, digest binary, keys array<bigint>")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, digest, shingles`` (sorted pairs of 64-bit hashes as bytes)."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = per_doc_sets(Words(*string_view(b.column(1)), wide=True), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, digest binary, shingles binary")


def _pairs(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64).reshape(-1, 2)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, mine = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, mine = a, _pairs(x)
                other = _pairs(y)
                n, m = len(mine), len(other)
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                at = np.minimum(np.searchsorted(mine[:, 0], other[:, 0]), n - 1)
                both = int((mine[at] == other).all(1).sum())
                if 100 * both >= percent * (n + m - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def compare_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between the left and the right block of one task, at most one for each left set and right root.

    Intersections are counted by matrix products over slices of the shingles that occur twice or more.
    """
    reps, roots = table.column("rep").to_numpy(), table.column("root").to_numpy()
    left, right = table.column("left").to_numpy(), table.column("right").to_numpy()
    raw = table.column("shingles").combine_chunks()
    sets = [_pairs(raw[i]) for i in range(len(raw))]
    size = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    names, first, where = np.unique(every[:, 0], return_index=True, return_inverse=True)
    if (every[first][where] != every).any():  # one first hash, two shingles
        names, where = np.unique(every, axis=0, return_inverse=True)
        where = where.ravel()
    count = np.bincount(where, minlength=len(names))
    column = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    some = count[where] > 1
    row, col = row[some], column[where[some]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    place = lambda ids: (lambda m: (m.__setitem__(ids, np.arange(len(ids))), m)[1])(np.full(len(sets), -1))
    in_a, in_b = place(a), place(b)
    both = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        r, c = row[lo:hi], col[lo:hi] - k * width
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        ok = in_a[r] >= 0
        x[in_a[r[ok]], c[ok]] = 1
        ok = in_b[r] >= 0
        y[in_b[r[ok]], c[ok]] = 1
        both += x @ y.T
    linked = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (roots[a][:, None] != roots[b][None, :])
    i, j = np.nonzero(linked)
    _, first = np.unique(np.stack([i, roots[b[j]]], 1), axis=0, return_index=True)
    one, two = reps[a[i[first]]], reps[b[j[first]]]
    return pa.table({"a": pa.array(np.minimum(one, two), pa.int64()), "b": pa.array(np.maximum(one, two), pa.int64())})


def company_links(company: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each company (``main, rep, root, stranger``): strangers against all, small ones as pairs, large ones in blocks."""
    sizes = company.groupBy("main").agg(F.count("*").alias("n"), F.count_if("stranger").alias("strangers"))
    few = company.join(sizes.where(F.col("n") <= COMPANY).select("main"), "main", "left_semi")
    pairs = few.where("stranger").select("main", F.col("rep").alias("p"), F.col("root").alias("pr")).join(few.select("main", F.col("rep").alias("q"), F.col("root").alias("qr")), "main").where("pr <> qr")
    small = confirm(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), sets, percent)

    # block numbers: strangers 0 .. s-1, then the others; a task (p, q) compares stranger block p with block q >= p
    ceil = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    many = company.join(sizes.where(F.col("n") > COMPANY), "main")
    s, m = ceil(F.col("strangers")), ceil(F.col("n") - F.col("strangers"))
    own = F.when(F.col("stranger"), F.pmod(F.xxhash64("rep"), s)).otherwise(s + F.pmod(F.xxhash64("rep"), F.greatest(m, F.lit(1))))
    placed = many.select("main", "rep", "root", s.alias("s"), (s + m).alias("all"), own.cast("int").alias("block"))
    up = F.transform(F.sequence("block", F.col("all") - 1), lambda q: F.struct(F.col("block").alias("p"), q.alias("q")))
    down = F.transform(F.sequence(F.lit(0), F.least("s", "block") - 1, F.lit(1)), lambda p: F.struct(p.alias("p"), F.col("block").alias("q")))
    tasks = F.concat(F.when(F.col("block") < F.col("s"), up).otherwise(F.array()), F.when(F.least("s", "block") > 0, down).otherwise(F.array()))
    copied = placed.select("main", "rep", "root", "block", F.explode(tasks).alias("t"))
    flat = copied.select("main", "rep", "root", F.col("t.p").alias("p"), F.col("t.q").alias("q"), (F.col("block") == F.col("t.p")).alias("left"), (F.col("block") == F.col("t.q")).alias("right"))
    full = flat.join(sets.select(F.col("node").alias("rep"), "shingles"), "rep")
    large = full.groupBy("main", "p", "q").applyInArrow(lambda t: tidy_group(compare_blocks, t, percent), "a bigint, b bigint")
    return small.union(large)


def open_companies(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """``main, rep, root, stranger`` of buckets (``key, rep``) that are not in one component: their largest component, and
    their members with their components."""
    placed = buckets.join(roots, "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    spread = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = placed.join(spread, "key", "left_semi")
    largest = mixed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
    return mixed.join(largest, "key").select("main", "rep", "root", (F.col("root") != F.col("main")).alias("stranger")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", unite_ids: bool = True, row_key: Column | None = None) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept, class_id, n_links``: the smallest
    id reachable, whether that is the row itself, the smallest id with the same set, and the number of
    confirmed links of that class (enough of them to connect its component). With ``row_key``, a string column of
    ``docs`` that tells rows of one id apart, ``row_key`` is returned as well.

    Nulls and edges: a null or blank text has an empty set, is linked with nothing and is kept; a text of
    fewer than ``k`` words has its whole sequence as one shingle; rows that repeat an id are nodes by their sets, and
    belong to one component (with ``unite_ids`` false: only if links join them, and of the nodes of a component only
    the one of the smallest id, and set, is kept); a row without id takes no part, is its own component (null) and is
    kept; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    told = (F.lit(None) if row_key is None else row_key).cast("string").alias("row_key")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), told)
    sig = scratch.keep(signature_table(rows, k), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # an id with several sets has a node for each; else the id is the node
    several = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    nodes = None
    if not several.isEmpty():
        every = full.select(F.struct("doc_id", "digest").alias("s")).distinct()
        nodes = scratch.keep(numbered(every, "s", "node").select("s.doc_id", "s.digest", "node"), "nodes")
    noded = (lambda df: df.join(nodes, ["doc_id", "digest"])) if nodes is not None else (lambda df: df.withColumn("node", F.col("doc_id")))
    full = noded(full)
    classes = scratch.keep(full.groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("members")), "classes")

    reps = full.join(classes.select(F.col("rep").alias("node"), "digest"), ["node", "digest"], "left_semi").dropDuplicates(["node"])
    keyed = reps.select(F.col("node").alias("rep"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).where("centre <> other").select("key", "centre")
    buckets = scratch.keep(keyed.join(shared, "key"), "buckets")
    pairs = scratch.keep(buckets.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs_0")
    ends = buckets.select("rep").distinct()
    ids = ends.select(F.col("rep").alias("doc_id")) if nodes is None else nodes.join(ends, nodes["node"] == ends["rep"], "left_semi").select("doc_id").distinct()
    worded = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))  # an id may have a blank text beside its own
    texts = worded.join(ids, "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"] if nodes is None else ["doc_id", "text"])
    own = noded(set_table(texts, k)).select("node", "shingles")
    if nodes is not None:  # texts of one id may differ and have one set
        own = own.join(ends, own["node"] == ends["rep"], "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep(own, "sets")
    links = scratch.keep(confirm(pairs, sets, percent), "links_0")
    scratch.release()

    def roots_of(edges: DataFrame, name: str) -> DataFrame:
        found = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), None, scratch)
        return scratch.keep(found.select(F.col("id").alias("rep"), "root"), name)

    roots = roots_of(links, "roots_0")
    for r in range(STARS + 1):
        company = scratch.keep(open_companies(buckets, roots), f"company_{r}")
        pick = F.min(F.when(F.col("stranger"), F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), F.col("rep").alias("p"), F.col("root").alias("pr"))))
        large = company.groupBy("main").agg(F.count("*").alias("n"), pick.alias("c")).where(F.col("n") > COMPANY).select("main", "c.p", "c.pr")
        if r == STARS or large.isEmpty():
            break
        star = company.join(large, "main").where("root <> pr").select(F.least("p", "rep").alias("a"), F.greatest("p", "rep").alias("b")).distinct()
        links = scratch.keep(links.union(confirm(star, sets, percent)).distinct(), f"links_star_{r}")
        roots = roots_of(links, f"roots_star_{r}")
    if not company.isEmpty():
        links = scratch.keep(links.union(company_links(company, sets, percent)).distinct(), "links_1")
        roots = roots_of(links, "roots_1")
    scratch.drop("sets", "buckets")

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    if nodes is not None and unite_ids:
        # classes that hold one id meet in that id, besides the links
        held = full.select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
        first = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
        roots = roots_of(links.unionByName(held.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))), "roots_2")
    named = classes.join(roots, "rep", "left").join(degree, "rep", "left").where("members > 1 OR root IS NOT NULL" if nodes is None else "true")
    # a document whose class is not here is alone in its class and component
    named = named.select("digest", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    if nodes is not None:  # nodes are numbered in order of their ids
        of = lambda c: nodes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_doc"))
        named = named.withColumn("winner", F.col("component_id")).join(of("class_id"), "class_id").join(of("component_id"), "component_id")
        named = named.select("digest", F.col("class_id_doc").alias("class_id"), F.col("component_id_doc").alias("component_id"), "n_links", "winner")
    named = scratch.keep(named, "named")
    side = F.broadcast(named) if named.count() <= BROADCAST_CLASSES else named
    out = sig.select("doc_id", "row_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(side, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id") == component
    if nodes is not None and not unite_ids:
        out = out.join(nodes.select(F.col("doc_id").alias("d_"), F.col("digest").alias("g_"), "node"), (F.col("doc_id") == F.col("d_")) & (F.col("digest") == F.col("g_")), "left")
        kept = F.coalesce(F.col("node") == F.col("winner"), F.lit(True))
    return out.select(
        "doc_id", *(["row_key"] if row_key is not None else []), "n_shingles", component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
