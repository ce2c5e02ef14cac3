import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, frame
from voxelweave.llm import exact_dedup as E


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = defaultdict(list)
    for i, x in enumerate(norm):
        groups[x].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        best = min(groups[norm[i]], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        keep = rows[best][0]
        out.append((doc, keep, len(groups[norm[i]]), doc == keep, hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, weak):
    """The weak hash makes nearly all chunk hashes ambiguous, so identifiers need their ordinals."""
    rows = awkward() + [(900, "ab. cd"), (901, "ab .cd "), (902, "abc.d"), (903, "a" * 96 + "." + "b" * 96 + "."), (904, "b" * 96 + "." + "a" * 96 + ".")]
    got = E.exact_dedup(frame(spark, rows), chunk_hash=(lambda c: F.length(c)) if weak else F.xxhash64).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chunks_cover_the_text(spark):
    for text in ("", "a", "." * 300, "x" * 5000, "ab." * 500):
        df = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(E.CHUNK), F.lit(0)).alias("c"))
        chunks = df.first()["c"]
        assert "".join(chunks) == text and all(len(c) <= E.MAX_CHUNK for c in chunks)


def test_empty(spark):
    assert E.exact_dedup(frame(spark, [])).count() == 0
