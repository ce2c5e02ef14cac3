"""Queries of this subpackage: name -> callable(spark, sf_dir), and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, centroids, chat, decontamination, exact_dedup, near_dedup, packing, pii, quality, suffix_dedup, tokens, toxicity, warc

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokens.tokenizer_path(TOKENIZER), 1024, 2)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80).drop("n_links")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 0.8)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(read(spark, sf_dir, "conversations"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digest(warc.archive_pages(read(spark, sf_dir, "pages"), with_payload=False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), 0.3)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(read(spark, sf_dir, "documents"), tokens.tokenizer_path(WORD_TOKENIZER))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(*centroids.cluster_vectors(read(spark, sf_dir, "embeddings"), k=16, rounds=3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


ORACLE: dict[str, str] = {
    "op1_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 49)) AS p, h FROM t WHERE len(h) >= 100),
             k AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) AS m FROM w),
             f AS (SELECT m, min(doc_id) AS first_id FROM k GROUP BY m),
             c AS (SELECT k.doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY k.doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM k JOIN f USING (m) WHERE k.doc_id > first_id),
             g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
             r AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY 1, 2),
             x AS (SELECT r.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
             y AS (SELECT x.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
                   FROM x JOIN t USING (doc_id) GROUP BY x.doc_id)
        SELECT t.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN y.doc_id IS NULL THEN h ELSE coalesce(head, '') || substr(h, 2 * tail + 1) END)) AS kept_sha256
        FROM t LEFT JOIN y USING (doc_id)""",
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
             n AS (SELECT doc_id, count(*) AS n, string_agg(sh, chr(10) ORDER BY sh) AS whole FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             e AS (SELECT x AS s, y AS d FROM l UNION SELECT y, x FROM l),
             r(id, lab) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.d, r.lab FROM r JOIN e ON e.s = r.id WHERE r.lab < e.d),
             m AS (SELECT id, min(lab) AS component_id FROM r GROUP BY id),
             k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n)
        SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept, coalesce(class_id, d.doc_id) AS class_id
        FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
    "op8_warc_transactions": r"""
        WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op12_centroid_clustering": r"""
        WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h
                   FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
             c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM k QUALIFY c < 16),
             a0 AS (SELECT vec_id, k.e, min({'d': list_sum(list_transform(list_zip(k.e, z.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'c': c}) AS m FROM k, c0 z GROUP BY ALL),
             s0 AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT m.c AS c, unnest(e) AS x, unnest(range(64)) AS p FROM a0) GROUP BY c, p),
             c1 AS (SELECT c, coalesce(n.e, z.e) AS e FROM c0 z LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s0 GROUP BY c) n USING (c)),
             a1 AS (SELECT vec_id, k.e, min({'d': list_sum(list_transform(list_zip(k.e, z.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'c': c}) AS m FROM k, c1 z GROUP BY ALL),
             s1 AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT m.c AS c, unnest(e) AS x, unnest(range(64)) AS p FROM a1) GROUP BY c, p),
             c2 AS (SELECT c, coalesce(n.e, z.e) AS e FROM c1 z LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s1 GROUP BY c) n USING (c)),
             a2 AS (SELECT vec_id, k.e, min({'d': list_sum(list_transform(list_zip(k.e, z.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'c': c}) AS m FROM k, c2 z GROUP BY ALL),
             s2 AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT m.c AS c, unnest(e) AS x, unnest(range(64)) AS p FROM a2) GROUP BY c, p),
             c3 AS (SELECT c, coalesce(n.e, z.e) AS e FROM c2 z LEFT JOIN (SELECT c, list(x ORDER BY p) AS e FROM s2 GROUP BY c) n USING (c)),
             f AS (SELECT vec_id, min({'d': list_sum(list_transform(list_zip(k.e, z.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'c': c}) AS m FROM k, c3 z GROUP BY ALL)
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c3.e, ',')) AS centroid_sha256
        FROM f JOIN c3 ON c3.c = m.c""",
}
