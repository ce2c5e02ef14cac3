"""BPE by distinct words: every text against the tokenizer itself."""

import random

import pytest

from tests.llm.helpers import awkward, frame
from voxelweave.llm import bpe, tokens

PATH = tokens.tokenizer_path("word_bpe_49k.json")
ODD = [
    "it's THEY'RE 'sample ''s don't I'LL", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext", "İstanbul ǅ Σας ΣΑΣ", "é Å ﬁ ½ ²3 Ⅷ", "\x00\x1c\x1f\x85\xa0  x", "한국어 漢字かな 🙂👩‍👩‍👧 ا ل ع",
    "1234.5678e-10", "___ --- ... $$$", "a" * 30000, "x " * 9000, "naïve café ÄÖÜ ß Ÿ ŉ", "̈ äö", "tab\tnew\nline\r\n", "‐–—‘’“”…€",
]


def expected(text):
    t = bpe.load(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_words_of_plain_characters_are_those_of_the_tokenizer():
    t, split = bpe.load(PATH), bpe.splitter(PATH)
    back = bpe._byte_chars()[1]
    own = lambda text: [bytes(back[c] for c in w).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]
    for c in bpe._PLAIN_CHARS:
        text = f"a{c}b' {c}'S 1{c}{c}2 {c}, 'LL'd{c}"
        assert bpe.PLAIN.fullmatch(c) and split(text) == own(text), hex(ord(c))


@pytest.mark.parametrize(("block_bytes", "hot_words"), [(1 << 24, 100_000), (3000, 50), (1, 0)])
def test_equals_the_tokenizer(spark, block_bytes, hot_words):
    rows = awkward(40) + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = bpe.encode_documents(frame(spark, rows).repartition(3), PATH, block_bytes=block_bytes, hot_words=hot_words).collect()
    want = [(i, *expected(t)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_random_characters(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + list("abc '.\n1")
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.3 else rng.choice("abcs' .1") for _ in range(60))) for i in range(150)]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_documents(frame(spark, rows), PATH, hot_words=20).collect()}
    assert got == {i: expected(t) for i, t in rows}


def test_other_ids_and_empty_tables(spark):
    text_ids = spark.createDataFrame([("a", "one Two"), (None, None)], "name string, body string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_documents(text_ids, PATH, "name", "body").collect()}
    assert got == {"a": expected("one Two")[0], None: []}
    assert bpe.encode_documents(frame(spark, []), PATH).collect() == []
    only = bpe.encode_documents(frame(spark, [(1, None), (2, " ")]), PATH).collect()
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in only) == [(1, [], ""), (2, [], "")]


def test_decode_any_ids(spark):
    t = bpe.load(PATH)
    rows = [(1, [49406, 320, 320, 1125, 49407]), (2, []), (3, None), (None, [518]), (4, [320, 999_999, 320])]
    got = {r["doc_id"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), PATH).collect()}
    assert got == {i: t.decode([x for x in ids or [] if x < 49408], skip_special_tokens=False) for i, ids in rows}
