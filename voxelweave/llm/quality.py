"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.boosting import Forest, fit
from voxelweave.llm.memory import small_batches, tidy_batches
from voxelweave.llm.text import Words, segments, slices, span_hashes, string_view
from voxelweave.scratch import Scratch

_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "line": b"\n\r", "stop": b".!?", "comma": b",;:",
    "bang": b"!", "pipe": b"|", "sign": b"%$&*#@^~=+<>", "quote": b"\"'`", "bracket": b"()[]{}", "dash": b"-_/\\", "high": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
GROUPS = np.zeros((256, len(_GROUPS)), np.float64)
for _j, _bytes in enumerate(_GROUPS.values()):
    GROUPS[list(_bytes), _j] = 1
NAMES = [
    "log_bytes", *_GROUPS, "entropy", "log_words", "word_len", "word_len_sd", "long_words", "distinct_words", "top_word", "caps_words", "signed_words",
    "log_lines", "line_len", "repeated_lines", "repeated_pairs", "stops_a_word",
]


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text of a slice; all zeros for an empty text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offsets)) + data, minlength=n * 256).reshape(n, 256)
    share = hist / some[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    w = Words(data, offsets)
    count = np.maximum(w.count, 1)
    length = (w.end - w.start).astype(float)
    per_doc = lambda values, docs: np.bincount(docs, values, n)
    mean = per_doc(length, w.doc) / count
    sd = np.sqrt(np.maximum(per_doc(length**2, w.doc) / count - mean**2, 0))
    caps = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    signs = np.concatenate([[0], np.cumsum(GROUPS[data, list(_GROUPS).index("sign")] > 0)])
    n_caps, n_small = caps[w.end] - caps[w.start], small[w.end] - small[w.start]

    def repeats(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the largest multiplicity of each document."""
        order = np.lexsort((hashes, docs))
        d, h = docs[order], hashes[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
        return np.bincount(d[at], minlength=n), top

    distinct, top = repeats(w.doc, w.hash)
    ls, le, ld = segments((data != 10) & (data != 13), offsets)
    lines = np.bincount(ld, minlength=n)
    d_lines, _ = repeats(ld, span_hashes(data, ls, le))
    near = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    pairs = np.bincount(w.doc[near], minlength=n)
    d_pairs, _ = repeats(w.doc[near], w.hash[near] * np.uint64(3) + w.hash[near + 1])
    out = np.column_stack([
        np.log1p(size), hist @ GROUPS / some[:, None], entropy, np.log1p(w.count), mean, sd, per_doc(length > 14, w.doc) / count,
        distinct / count, top / count, per_doc((n_caps > 1) & (n_small == 0), w.doc) / count, per_doc(signs[w.end] > signs[w.start], w.doc) / count,
        np.log1p(lines), size / np.maximum(lines, 1), 1 - d_lines / np.maximum(lines, 1), 1 - d_pairs / np.maximum(pairs, 1), hist[:, [33, 46, 63]].sum(1) / count,
    ])
    out[size == 0] = 0
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x array<float>`` for every row; a null text counts as empty."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = document_statistics(*string_view(b.column(1))).astype(np.float32)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, x array<float>")


def held_out() -> F.Column:
    """Whether crc32 of the id, as text, is a multiple of 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids outside the held-out fold, by hash order, with ``y`` (conflicting labels: the larger)."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(stats: DataFrame, labels: DataFrame, max_rows: int = 12000) -> Forest:
    """Fit on at most ``max_rows`` labelled rows (a bounded sample, by hash order); only their statistics reach the driver, in
    order of their ids. Of the rows of one id, the one with the smallest statistics."""
    rows = stats.join(F.broadcast(training_ids(labels, "quality", max_rows)), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows = sorted((r["doc_id"], r["x"], r["y"]) for r in rows)
    x = np.array([r[1] for r in rows], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r[2] for r in rows], float))


def score_documents(stats: DataFrame, forest: Forest, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of a statistics table."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12000) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``, one row per input row.

    A null or empty text is scored like any other (its statistics are zeros); repeated rows are scored
    alike; a null id is not held out; labels of unknown documents, null labels and labels other than 0 and 1
    are not used; without both classes the score is the smoothed class rate; other columns are ignored; an
    empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(statistics_table(docs), "stats")
    return score_documents(stats, train(stats, labels, max_rows), threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 12000) -> DataFrame:
    """The rows, with all their columns, whose score is ``threshold`` or more; one pass, nothing is shuffled.

    Only the bounded training sample is looked up first. Cases as in ``quality_scores``.
    """
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(training_ids(labels, "quality", max_rows).select("doc_id")), "doc_id")
    forest = train(statistics_table(sample), labels, max_rows)
    place = docs.columns.index("text")

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = document_statistics(*string_view(b.column(place))).astype(np.float32).astype(float)
            yield b.filter(pa.array(forest.score(x) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
