"""The pipeline against brute force, stage by stage."""

import random
import re

import pytest

import corpus_pipeline as CP
from tests.llm.helpers import edited, prose
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check_layout


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        good = rng.random() < 0.75
        t = prose(rng, rng.randint(40, 90))
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split())))
        labels.append((i, int(good), 0))
    base = [t for (i, t), (_, q, _) in zip(rows, labels, strict=True) if q]
    rows += [(300 + i, base[i]) for i in range(10)] + [(320 + i, edited(rng, base[20], 0.01)) for i in range(12)]
    rows += [(350 + i, base[30 + i] + " " + items[i][1]) for i in range(5)] + [(400, None), (401, ""), (None, base[60]), (402, base[61] + " " + prose(rng, 2500))]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in CP.STAGES:
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bad = {i for i, t in rows if t and t.isupper() is False and "!!" in t}
    kept = {i for i, _ in seen["quality"]}
    assert len(kept & bad) <= 2 and all(i in kept for i, t in rows if t and "!!" not in t)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in seen["quality"]:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    assert sorted((i for i, _ in seen["exact_dedup"]), key=repr) == sorted((min(g)[2] for g in groups.values()), key=repr)
    want = {i for i, (_, root) in brute(seen["exact_dedup"], 5, 80).items() if i == root}
    assert {i for i, _ in seen["near_dedup"] if i is not None} == want
    gone = {i for i, _ in seen["near_dedup"]} - {i for i, _ in seen["decontamination"]}
    assert gone == {i for i, t in seen["near_dedup"] if any(x in (t or "") for _, x in items)} and len(gone) >= 4
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in seen["decontamination"]}
    check_layout(packed, 1024)


def test_stages_judge_rows_and_keep_columns(spark, folder, tmp_path):
    """Repeated ids with different texts, repeated rows, nulls, columns with the operators' own names, empty tables."""
    d, _, items = folder
    rng = random.Random(5)
    a, b, c = (prose(rng, 50) for _ in range(3))
    kind = "doc_id bigint, text string, leaks_ int, row_key string, kept boolean, gone_id_ bigint, node int"
    full = lambda rows: spark.createDataFrame([(i, t, k, "r", None, 7, None) for k, (i, t) in enumerate(rows)], kind)
    show = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    rows = [(1, "same"), (2, "same"), (2, "a text of its own"), (2, "sa me"), (3, "x"), (3, "x"), (None, "x"), (None, None), (4, ""), (5, None)]
    got = CP.drop_copies(spark, full(rows), d)
    assert got.columns == full([]).columns
    assert show(got) == sorted([(2, "sa me"), (2, "a text of its own"), (3, "x"), (4, "")], key=repr)
    near = [(1, a), (2, a + " x"), (2, b), (6, b), (7, c), (7, c), (None, a), (None, None), (8, ""), (9, None)]
    assert show(CP.drop_near_copies(spark, full(near), d)) == sorted([(1, a), (2, b), (7, c), (7, c), (None, a), (None, None), (8, ""), (9, None)], key=repr)
    leak = [(1, a + " " + items[0][1]), (1, b), (2, None), (None, c), (None, items[1][1]), (3, c), (3, c)]
    got = CP.drop_leaks(spark, full(leak), d)
    assert got.columns == full([]).columns and show(got) == sorted([(1, b), (2, None), (None, c), (3, c), (3, c)], key=repr)
    assert {r["leaks_"] for r in got.collect()} == {1, 2, 3, 5, 6}
    assert CP.keep_quality(spark, full(leak), d).columns == full([]).columns
    for name, stage in CP.STAGES:
        none = stage(spark, full([]), d)
        assert none.count() == 0 and (name == "packing" or none.columns == full([]).columns)


def test_run(spark, folder):
    got = CP.run(spark, folder[0])
    assert got.count() > 100 and "sequence_id" in got.columns and CP.ORACLE_SQL is None
