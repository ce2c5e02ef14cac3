"""BPE encoding and decoding by a table of distinct words.

A pre-tokenised BPE looks at one word at a time, so a corpus needs each distinct word encoded once. Texts are split
into words in blocks; a block keeps its own word list and, for every document, places in that list. The lists meet in
one table of distinct words, which is encoded. Ids then go back to the blocks; there they are joined with the vocabulary's
pieces, once a word of the block, and both are laid out by position. ``decode`` is that join for any table of ids.

What is shuffled is a word once a block, never its occurrences. Words that most blocks have come back in a broadcast of
bounded size, so no key of the join back has a row for every block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxelweave.llm.memory import small_batches, tidy_batches, tidy_group
from voxelweave.llm.text import slices
from voxelweave.scratch import Scratch

#: Bytes of text a block (or one longer document): its word list and its documents' ids have to fit a worker.
BLOCK = 16 << 20
#: Words that come back by broadcast at most, and the longest of them in characters: 100,000 short words, some 4 MB.
HOT_WORDS, HOT_LENGTH = 100_000, 32
#: Buckets of the table of blocks at most.
PARTITIONS = 100_000
#: Characters that Python and the tokenizer lower-case and classify alike (a test goes through all of them).
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
_PLAIN_CHARS = [c for c in map(chr, (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC))]


@lru_cache(maxsize=1)
def load(path: str):
    """The tokenizer of a ``tokenizers`` file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def _byte_chars() -> tuple[list[str], dict[str, int]]:
    """The character that stands for each byte in a byte-level vocabulary, from its rule: printable Latin-1 stands for
    itself, other bytes for the characters from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    chars = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
    return chars, {c: b for b, c in enumerate(chars)}


def byte_level(word: str) -> str:
    chars = _byte_chars()[0]
    return word if word.isascii() and word.isprintable() and " " not in word else "".join(chars[b] for b in word.encode())


def splitter(path: str) -> Callable[[str], list[str]]:
    """Function from a text to its words: what the tokenizer's normaliser and pre-tokenizer leave of it (not yet in
    byte-level characters), and the added tokens that occur in it, whole.

    Texts of plain characters go through one regular expression, all others through the tokenizer's own parts.
    """
    import unicodedata

    tokenizer = load(path)
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    found = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
    starts = tuple({t[:2] for t in added})
    low = {x for c in _PLAIN_CHARS for x in c.lower()}
    letters, numbers = (re.escape("".join(sorted(c for c in low if unicodedata.category(c)[0] == k))) for k in "LN")
    words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t\n\r {letters}{numbers}]+")
    back = _byte_chars()[1]

    def exact(text: str) -> list[str]:
        out = []
        for part in found.split(text) if found else [text]:
            if part in added:
                out.append(part)
            elif part:
                plain = tokenizer.normalizer.normalize_str(part) if tokenizer.normalizer else part
                out += [bytes(back[c] for c in piece).decode() for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def split(text: str) -> list[str]:
        if PLAIN.fullmatch(text) and not any(s in text for s in starts):
            return words.findall(text.lower())
        return exact(text)

    return split


def word_encoder(path: str) -> Callable[[str], list[int]]:
    """Function from one word of ``splitter`` to its ids."""
    tokenizer = load(path)
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return lambda word: [added[word]] if word in added else [t.id for t in tokenizer.model.tokenize(byte_level(word))]


def vocabulary_table(path: str) -> pa.Table:
    """``id, piece`` of a tokenizer, added tokens included: as many rows as the vocabulary has, whatever the corpus."""
    table = load(path).get_vocab(with_added_tokens=True)
    return pa.table({"id": pa.array(table.values(), pa.int32()), "piece": pa.array(table.keys(), pa.string())})


def pack_places(places: np.ndarray) -> bytes:
    """Numbers below 2**35 in seven bits a byte, low bits first; all but a number's last byte have the top bit set."""
    size = np.ones(len(places), np.int64)
    for bits in (7, 14, 21, 28):
        size += places >= 1 << bits
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(5):
        has = size > j
        out[at[has] + j] = (places[has] >> 7 * j) & 127 | np.where(size[has] > j + 1, 128, 0)
    return out.tobytes()


def unpack_places(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8)
    end = np.flatnonzero(raw < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for j in range(5):
        has = end - start >= j
        out[has] |= (raw[start[has] + j] & 127).astype(np.int64) << 7 * j
    return out


def split_blocks(docs: DataFrame, path: str, block_bytes: int = BLOCK) -> DataFrame:
    """Documents (``doc_id, text``) as blocks: one row a block with its list ``words``, most frequent first, and rows of
    ``doc_ids``, ``counts`` (words of each) and ``places`` (of the words in the list, all documents in order)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task = splitter(path), TaskContext.get().partitionId()
        number, size, seen, held = 0, 0, {}, []

        def rows() -> Iterator[pa.RecordBatch]:
            """The block at hand, its words numbered anew by frequency."""
            often = np.bincount(np.concatenate([p for *_, p in held]), minlength=len(seen)) if held else np.zeros(0, np.int64)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = pa.array(list(seen), pa.string()).take(pa.array(order))
            parts = [(held[0][0].slice(0, 0), [], None, words)] if held else []
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            none = pa.array([], pa.string())
            for ids, counts, places, listed in parts + [(i, c, pack_places(rank[p]), none) for i, c, p in held]:
                cols = [pa.array([task << 24 | number], pa.int64()), one(ids), one(pa.array(counts, pa.int32())), pa.array([places], pa.binary()), one(listed)]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "counts", "places", "words"])

        for part in slices(batches, "text"):
            counts, places = [], []
            for text in part.column(1).to_pylist():
                words = split(text) if text else []
                counts.append(len(words))
                places += [seen.setdefault(w, len(seen)) for w in words]
                size += len(text or "")
            held.append((part.column(0), counts, np.array(places, np.int64)))
            if size >= block_bytes:
                yield from rows()
                number, size, seen, held = number + 1, 0, {}, []
        yield from rows()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"block bigint, doc_ids array<{id_type}>, counts array<int>, places binary, words array<string>")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``ids`` beside the columns of a table of distinct words (``word`` and others)."""

    @tidy_batches
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for part in slices(batches, "word"):
            ids = [encode(w) for w in part.column(part.schema.get_field_index("word")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, "ids"])

    return words.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in words.schema.fields)}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and the text of its ``ids`` (array<int>): pieces by a join with the vocabulary, put together by position,
    with the space between two that a tokenizer without a decoder writes.

    ``key`` has to tell rows apart. A null or empty list gives an empty text; an id that the vocabulary lacks gives
    nothing. Special tokens are written like any other. The vocabulary is broadcast: its size is the tokenizer's.
    """
    tokens = encoded.select(F.col(key).alias("key_"), F.posexplode("ids").alias("at_", "id"))
    named = tokens.join(F.broadcast(encoded.sparkSession.createDataFrame(vocabulary_table(path))), "id")
    texts = named.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("at_", "piece"))).alias("p_")).select("key_", F.array_join(F.col("p_.piece"), " ").alias("told_"))
    return encoded.join(texts, encoded[key].eqNullSafe(texts["key_"]), "left").select(F.col(key), F.coalesce("told_", F.lit("")).alias(text_col))


def _layer(hot: pa.Table, pieces: pa.Table, id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Lay out one block: its rows of ``split_blocks``, and the ids of those of its words that are not hot."""

    def run(block: pa.Table, rest: pa.Table) -> pa.Table:
        words = block.filter(pc.is_null(block.column("places"))).column("words").combine_chunks().flatten()
        # ids of the block's words, by place: hot ones by name, the others by the place they came from
        known = pa.concat_arrays([hot.column("ids").combine_chunks(), rest.column("ids").combine_chunks().cast(hot.schema.field("ids").type)])
        at = pc.index_in(words, hot.column("word").combine_chunks()).to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), -1, at).astype(np.int64)
        at[rest.column("place").to_numpy()] = len(hot) + np.arange(len(rest))
        if (at < 0).any():
            raise RuntimeError("a word of a block has not come back")
        ids = known.take(pa.array(at))
        # the join of ids with pieces, once a word of the block
        piece = pieces.column("piece").combine_chunks().take(pc.index_in(ids.flatten(), pieces.column("id").combine_chunks()))
        told = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, piece), " ") if len(ids) else piece
        out = [pa.table({"doc_id": pa.array([], id_type), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.string())})]
        for row in block.filter(pc.is_valid(block.column("places"))).select(["places", "doc_ids", "counts"]).to_batches(max_chunksize=1):
            places = pa.array(unpack_places(row.column(0)[0].as_py()))
            ends = np.concatenate([[0], np.cumsum(row.column(2).flatten().to_numpy())]).astype(np.int64)
            own = ids.take(places)
            start = own.offsets.to_numpy() if len(own) else np.zeros(1, np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(start[ends] - start[0], pa.int32()), own.flatten())
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told.take(places)), " ")
            out.append(pa.table({"doc_id": row.column(1).flatten().cast(id_type), "ids": tokens.cast(pa.list_(pa.int32())), "decoded": texts}))
        return pa.concat_tables(out)

    return lambda block, rest: tidy_group(run, block, rest)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every row's whole text, as the tokenizer's ``encode`` (no special tokens
    added, no truncation) and ``decode`` (none skipped) give them.

    A null or empty text has no ids and decodes to an empty text; added tokens that stand in a text are found as the
    tokenizer finds them; a repeated row, a repeated id and a null id are rows like any other; a text longer than a
    block is a block of its own and has to fit a worker, with its ids; other columns are left behind; an empty table
    gives an empty table. The tokenizer is a byte-level BPE file whose pre-tokenizer ends in byte level, with no
    decoder and no post-processor.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = min(PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    blocks = scratch.bucketed(split_blocks(rows, path, block_bytes), "blocks", "block", n, dealt=True, codec="zstd")
    listed = blocks.where("places IS NULL").select("block", F.posexplode("words").alias("place", "word"))
    table = scratch.keep(encode_words(listed.groupBy("word").agg(F.count("*").alias("n_blocks")), path), "words", "zstd")
    scratch.release()
    hot = table.where(F.length("word") <= HOT_LENGTH).orderBy(F.desc("n_blocks"), "word").limit(hot_words).select("word", "ids").toArrow()
    rare = listed.join(F.broadcast(spark.createDataFrame(hot.select(["word"]))), "word", "left_anti") if hot.num_rows else listed
    rest = rare.join(table.select("word", "ids"), "word").select(F.col("block").alias("of"), "place", "ids")
    rest = scratch.keep(rest, "rest", "zstd")
    scratch.drop("words")
    kind = blocks.schema["doc_ids"].dataType.elementType
    layer = _layer(hot, vocabulary_table(path), to_arrow_type(kind))
    return blocks.groupBy("block").cogroup(rest.groupBy("of")).applyInArrow(layer, f"doc_id {kind.simpleString()}, ids array<int>, decoded string")
