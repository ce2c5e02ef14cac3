import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import awkward, frame, prose
from voxelweave.llm import boosting
from voxelweave.llm import quality as Q


def test_boosting_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = boosting.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    # the array walk equals a walk node by node
    code = f.codes(x[:20])
    for r in range(20):
        total = f.base
        for t in range(len(f.feature)):
            k = 0
            while f.left[t, k] != k:
                k = f.left[t, k] if code[r, f.feature[t, k]] <= f.split[t, k] else f.right[t, k]
            total += f.value[t, k]
        assert abs(total - f.raw(x[r : r + 1])[0]) < 1e-9
    one = boosting.fit(x[:10], np.ones(10))
    assert np.allclose(one.score(x), 10.5 / 11)
    assert boosting.fit(np.zeros((0, 5)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def labelled(spark, n=500):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(30, 90))
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()) if i % 2 else t.replace(" ", "$$$ ")))
        labels.append((i, int(good), 0))
    return rows, spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"), labels


def test_held_out_accuracy_and_filter(spark):
    rows, lab, labels = labelled(spark)
    got = {r["doc_id"]: r for r in Q.quality_scores(frame(spark, rows), lab).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    kept = Q.accepted(frame(spark, rows), lab)
    assert set(kept.columns) == set(frame(spark, rows).columns)
    ids = {r["doc_id"] for r in kept.collect()}
    assert all((i in ids) == bool(labels[i][1]) for i in held)


def test_edges(spark):
    rows, lab, _ = labelled(spark, 120)
    odd = awkward()
    got = Q.quality_scores(frame(spark, odd), lab).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if r["doc_id"] in (160, 161)}
    assert len(same) == 1
    assert Q.quality_scores(frame(spark, []), lab).count() == 0
    assert Q.quality_scores(frame(spark, rows[:3]), lab.limit(0)).count() == 3


def plain_statistics(text):
    """Some of the statistics, word by word."""
    b = text.encode()
    if not b:
        return dict.fromkeys(Q.NAMES, 0.0)
    words, low = re.findall(rb"[^\x20\x09-\x0D]+", b), re.findall(rb"[^\x20\x09-\x0D]+", b.lower())
    lines, n = re.findall(rb"[^\r\n]+", b), max(len(words), 1)
    pairs = list(zip(low, low[1:], strict=False))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    share = [c / len(b) for c in Counter(b).values()]
    caps = [w for w in words if len(re.findall(rb"[A-Z]", w)) > 1 and not re.search(rb"[a-z]", w)]
    return {
        "log_bytes": math.log1p(len(b)), "upper": len(re.findall(rb"[A-Z]", b)) / len(b), "digit": len(re.findall(rb"[0-9]", b)) / len(b), "high": sum(c > 127 for c in b) / len(b),
        "entropy": -sum(s * math.log2(s) for s in share), "log_words": math.log1p(len(words)), "word_len": mean, "word_len_sd": math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0)),
        "long_words": sum(s > 14 for s in sizes) / n, "distinct_words": len(set(low)) / n, "top_word": max(Counter(low).values(), default=0) / n, "caps_words": len(caps) / n,
        "signed_words": sum(bool(re.search(rb"[%$&*#@^~=+<>]", w)) for w in words) / n, "log_lines": math.log1p(len(lines)), "line_len": len(b) / max(len(lines), 1),
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1), "repeated_pairs": 1 - len(set(pairs)) / max(len(pairs), 1), "stops_a_word": len(re.findall(rb"[!.?]", b)) / n,
    }


def test_statistics_against_plain_python():
    rng = random.Random(4)
    texts = ["", " ", "A", "AB cd\nAB cd\r\nX9 $5 +", "é漢 🙂!", *(prose(rng, rng.randint(1, 80)) + rng.choice(["", "\n\nBUY NOW 100%", " x" * 30]) for _ in range(30))]
    raw = [t.encode() for t in texts]
    x = Q.document_statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, row in zip(texts, x, strict=True):
        for name, value in plain_statistics(t).items():
            assert abs(row[Q.NAMES.index(name)] - value) < 1e-9, (t, name)


def test_split_search_finds_the_best_cut():
    """One tree of one cut on one feature is the cut of least squared error over the bins."""
    rng = np.random.default_rng(5)
    x = rng.random((500, 1))
    y = (x[:, 0] > 0.37).astype(float)
    f = boosting.fit(x, y)
    assert ((f.score(x) > 0.5) == y).mean() > 0.98
