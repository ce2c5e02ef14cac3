"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. A normalised
text is cut behind content-defined anchors (sentence marks, at least ``MIN_CHUNK`` and at most
``MAX_CHUNK`` characters apart); its recipe is the ordered list of its chunks' identifiers. Distinct
chunks meet once, combined on the map side, to verify that a chunk's 64-bit hash stands for one content
only; where it does not, the identifier gets the chunk's ordinal among the contents that share the hash.
Documents are then compared by recipe, so a long text never moves again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelweave.scratch import Scratch

MIN_CHUNK, MAX_CHUNK = 96, 1024
SPACES = r"[\x20\x09-\x0D]+"
#: Identifiers in groups of equal documents up to which these are broadcast (16 MB); above, the join shuffles.
BROADCAST_LONGS = 2_000_000
ANCHOR = r"[.!?;:|%…。！？]"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?{ANCHOR}|.{{1,{MAX_CHUNK}}}"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64, row_key: Column | None = None) -> DataFrame:
    """Decide for every row which row of its equality group stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts, the
    one with the most code points in the original text stays, then the smallest id.

    Nulls and edges: a null text counts as empty, and empty texts are equal to each other; a null id sorts
    behind all others; repeated rows with one id count each and share their decision; other columns of
    ``docs``, whatever their names, are ignored; an empty table gives an empty table.

    With ``row_key``, an expression over ``docs`` that tells rows of one id apart, the columns ``row_key`` and ``n_cp``
    (code points of the original text) are returned as well. ``chunk_hash`` may be any 64-bit hash; a weak one only costs time (tests use a constant-like one).
    """
    scratch = Scratch(docs.sparkSession, "exact")
    told = [] if row_key is None else ["row_key"]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([] if row_key is None else [row_key.alias("row_key")]))
    norm = base.select("doc_id", *told, F.length("t").cast("bigint").alias("n_cp"), F.regexp_replace("t", SPACES, "").alias("norm"))
    chunked = norm.select("doc_id", *told, "n_cp", F.sha2("norm", 256).alias("text_sha256"), F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))

    distinct = chunked.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).cast("bigint").alias("h"), "chunk").distinct()
    shared = scratch.keep(distinct.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "ambiguous")
    recipes = chunked.select("doc_id", *told, "n_cp", "text_sha256", F.transform("chunks", lambda c: chunk_hash(c).cast("bigint")).alias("recipe"))
    if shared.isEmpty():
        recipes = recipes.withColumn("ordinals", F.array().cast("array<int>"))
    else:
        # ordinals of the ambiguous chunks, in order of position; keyed by the digest, as ids may repeat
        named = distinct.join(shared, "h", "left_semi").withColumn("ordinal", F.row_number().over(W.partitionBy("h").orderBy("chunk")))
        placed = chunked.select("text_sha256", "chunks").dropDuplicates(["text_sha256"]).select("text_sha256", F.posexplode("chunks").alias("pos", "chunk"))
        placed = placed.withColumn("h", chunk_hash(F.col("chunk")).cast("bigint")).join(named, ["h", "chunk"])
        lists = placed.groupBy("text_sha256").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))), lambda x: x["ordinal"]).alias("ordinals"))
        recipes = recipes.join(lists, "text_sha256", "left").withColumn("ordinals", F.coalesce("ordinals", F.array().cast("array<int>")))
    recipes = scratch.keep(recipes.select("doc_id", *told, "n_cp", "text_sha256", "recipe", "ordinals"), "recipes")

    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id")))
    groups = recipes.groupBy("recipe", "ordinals").agg(best.alias("best"), F.count("*").alias("size_")).where("size_ > 1")
    groups = scratch.keep(groups.select("recipe", "ordinals", F.col("best.id").alias("best_id"), "size_"), "groups")
    # a row that meets no group of two or more is alone; large groups are one row here, however many rows meet them
    longs = groups.agg(F.sum(F.size("recipe") + F.size("ordinals") + 8)).first()[0] or 0
    out = recipes.join(F.broadcast(groups) if longs <= BROADCAST_LONGS else groups, ["recipe", "ordinals"], "left")
    alone = F.col("size_").isNull()
    out = out.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")))
    return out.select("doc_id", "keep_id", F.coalesce("size_", F.lit(1)).cast("bigint").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *([*told, "n_cp"] if told else []))
