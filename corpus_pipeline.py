"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate, pack.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, the
next stage's ``docs``. All but the last return the columns they got. A stage's decisions are rows removed;
nothing is sampled or capped. Decisions are about rows, told apart by id and text. Each stage states its cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import decontamination, exact_dedup, near_dedup, packing, quality, tokens
from voxelweave.scratch import Scratch

#: Rows up to which a set of removed rows is broadcast (some 80 bytes each); above, both sides are shuffled.
BROADCAST_ROWS = 200_000


def _row_key() -> Column:
    """Tells texts of one id apart."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone`` (``doc_id, row_key``), which are broadcast only if they are few."""
    side = gone.select(F.col("doc_id").alias("gone_id_"), F.col("row_key").alias("gone_key_"))
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    return docs.join(side, docs["doc_id"].eqNullSafe(side["gone_id_"]) & (_row_key() == side["gone_key_"]), "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    A null or empty text is scored like any other (all statistics 0); rows of equal text share their fate, whatever
    their ids; rows without id are judged, but never trained on; without labels of both classes nothing goes, as the
    score is then the class rate or one half; an empty table stays empty; other columns pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one row of each equality group stays.

    Of equal texts, the one with the most code points stays, then the smallest id (null last), then the smallest digest
    of the text as it stands; of rows that are alike in id and text, the first by their other columns. Rows that repeat
    an id with another text are judged by their own text. Null and empty texts are equal to each other. An empty table
    stays empty; other columns, whatever their names, pass through.
    """
    scratch = Scratch(spark, "copies")
    decided = exact_dedup.exact_dedup(docs, row_key=_row_key()).where("group_size > 1").select("doc_id", "row_key", "n_cp", "text_sha256")
    decided = scratch.keep(decided.groupBy("doc_id", "row_key", "text_sha256").agg(F.first("n_cp").alias("n_cp"), F.count("*").alias("rows")), "decided")
    order = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row_key").alias("k"))
    stays = scratch.keep(decided.groupBy("text_sha256").agg(F.min(F.struct(order.alias("o"), "rows")).alias("b")).select("b.o.i", "b.o.k", "b.rows"), "stays")
    first = stays.select(F.col("i").alias("doc_id"), F.col("k").alias("row_key"))
    gone = decided.join(first.select(F.col("doc_id").alias("i"), F.col("row_key").alias("k")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_key") == F.col("k")), "left_anti")
    out = _without(docs, scratch.keep(gone.select("doc_id", "row_key"), "gone"))
    again = stays.where("rows > 1").select(F.col("i").alias("doc_id"), F.col("k").alias("row_key"))
    if again.isEmpty():
        return out
    one = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns)))
    side = again.select(F.col("doc_id").alias("again_id_"), F.col("row_key").alias("again_key_"))
    alike = docs.join(side, docs["doc_id"].eqNullSafe(F.col("again_id_")) & (_row_key() == F.col("again_key_")))
    return _without(out, again).unionByName(alike.groupBy("again_id_", "again_key_").agg(one.alias("row_")).select("row_.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: of each component the text of the smallest id stays.

    Texts of one id are judged each by its own words (if they are near copies of each other, the smaller digest of
    their sets stays); texts of one set and one id stay together, and so do rows without id, and null and blank texts.
    An empty table stays empty; other columns pass through.
    """
    decided = near_dedup.near_duplicates(docs, k=5, percent=80, unite_ids=False, row_key=_row_key()).where("NOT kept AND doc_id IS NOT NULL")
    return _without(docs, Scratch(spark, "near_copies").keep(decided.select("doc_id", "row_key").distinct(), "gone"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that leak an item go.

    Rows are judged by their text alone, so repeated rows and rows without id are like any other; null and empty texts
    leak nothing; an empty table or benchmark takes nothing away; other columns, whatever their names, pass through.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = "leaks_"
    while name in docs.columns:
        name += "_"
    return decontamination.with_leaks(docs, items, 0.8, column=name).where(F.size(name) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens.

    A null or empty text is its end token; repeated rows are packed again; a null id stays null; an empty table gives
    an empty table; other columns are left behind.
    """
    return packing.pack_documents(docs, tokens.tokenizer_path(), 1024, 2)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Classifier, similarity search and tokenizer have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            scratch.release()
    return docs
