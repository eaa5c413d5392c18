"""Token ids in binary blocks: one zstandard frame a document, a shared dictionary, an offset index.

A block is one byte string and one row of a Parquet table, so that blocks are
written by Spark's own writer: any store that Spark reaches, task commits, and
no half-written block when an executor is lost.  Layout, all little-endian:

    magic "TIDS", version (1 byte), bytes per id (2 or 4, 1 byte), 2 zero bytes,
    SHA-256 of the dictionary (32 bytes; zeros if there is none),
    number of documents (4 bytes),
    per document: doc_id (8 bytes, 0 if null),
    per document: 1 byte, 1 if the doc_id is null,
    per document: number of ids with the end id (8 bytes),
    per document and one more: where its frame starts in the frames (8 bytes),
    the frames.

``document_at`` decompresses one document of a block without touching others.
The dictionary serves short documents: it is trained on the id arrays of
``DICTIONARY_DOCS`` whole documents of at most ``DICTIONARY_CHARS`` characters,
chosen by a hash of doc_id.  This bound concerns the dictionary alone; every
document is written whole.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_automaton import _LATIN as BEYOND_LATIN
from .bpe_automaton import byte_alphabet, split_words, vocabulary_path
from .common import batches_of, documents, shared_dir
from .tokens import END_OF_TEXT, LONGEST, PieceCache, WordCache

DICTIONARY_DOCS = 400
DICTIONARY_CHARS = 8192
DICTIONARY_BYTES = 32768
BLOCK_BYTES = 1 << 20
END_ID = 0
#: What ``bpe_automaton.PATTERN`` is for ASCII, where Python's own expressions are faster.
ASCII_WORDS = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""")
#: Words within pieces that a worker holds at most.
KNOWN_WORDS = 50_000
#: Pieces of texts that aren't cut into words that a worker holds at most.
ODD_PIECES = 200_000
#: New words that one call of the library encodes.
WORDS_AT_ONCE = 1000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def id_width(path: str) -> int:
    return 2 if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def splits_plainly(tokenizer) -> bool:
    """Whether the tokenizer only splits texts into words, at its one added token too, and merges bytes of words."""
    steps = json.loads(tokenizer.to_str())
    splitter = {k: (steps["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
    plain = splitter == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and steps["normalizer"] is None and steps["post_processor"] is None
    return plain and steps["model"]["type"] == "BPE" and not steps["model"]["dropout"] and [x["content"] for x in steps["added_tokens"]] == [END_OF_TEXT]


def word_ids(tokenizer, kind: str) -> Callable[[list[bytes]], list[bytes]]:
    """The library's ids of words, many in one call: its tokenizer over the same model, which splits at line feeds.

    Line feeds don't occur in the printable form of words; between two words
    stands the token of a line feed, so that their ids can be told apart.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    by_line = Tokenizer(tokenizer.model)
    by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    alphabet = {b: c for c, b in byte_alphabet().items()}
    shown = "".join(alphabet[b] for b in range(256))
    (mark,) = [t.id for t in tokenizer.model.tokenize(shown[10])]

    def ids(words: list[bytes]) -> list[int]:
        joined = f"\n{shown[10]}\n".join([codecs.charmap_decode(w, "strict", shown)[0] for w in words])
        return by_line.encode_batch_fast([joined], add_special_tokens=False)[0].ids

    def of_words(words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        feeds = [k for k, w in enumerate(words) if b"\n" in w]
        for k in feeds:
            out[k] = array(kind, ids([words[k]])).tobytes()
        others = [k for k, w in enumerate(words) if b"\n" not in w] if feeds else range(len(words))
        for at in range(0, len(others), WORDS_AT_ONCE):
            part = others[at : at + WORDS_AT_ONCE]
            found = np.array(ids([words[k] for k in part]), kind)
            ends, whole = (np.append(np.flatnonzero(found == mark), len(found)) * found.itemsize).tolist(), found.tobytes()
            for k, a, b in zip(part, [0, *(e + found.itemsize for e in ends)], ends, strict=False):
                out[k] = whole[a:b]
        return out

    return of_words


def piece_ids(tokenizer) -> Callable[[str], list[int]]:
    """The library's ids of a text without added tokens.

    Where the tokenizer only splits words and merges bytes, its model is asked
    word by word: new pieces are many, and most of an encoding's time goes into
    offsets and masks that nothing reads.
    """
    if not splits_plainly(tokenizer):
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    model = tokenizer.model
    shown, tokenize, known = {b: c for c, b in byte_alphabet().items()}, model.tokenize, {}

    def of_word(word: str) -> list[int]:
        # Printable characters of ASCII stand for themselves.
        seen = word.replace(" ", shown[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(shown)
        return [t.id for t in tokenize(seen)]

    def of_piece(piece: str) -> list[int]:
        if piece[piece[:1] == " " :].isalpha() and (piece.isascii() or not BEYOND_LATIN.search(piece)):
            return of_word(piece)
        if piece.isascii():
            words = ASCII_WORDS.findall(piece)
        else:
            words = split_words(piece)
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = []
        for word in words:
            if (ids := known.get(word)) is None:
                ids = of_word(word)
                if len(word) <= LONGEST:
                    known[word] = ids
            out += ids
        return out

    return of_piece


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordCache:
    """Texts to the bytes of ids of ``id_width(path)`` bytes each, by the tokenizers library."""
    tokenizer, kind = _tokenizer(path), "H" if id_width(path) == 2 else "I"
    of_piece, plain = piece_ids(tokenizer), splits_plainly(tokenizer)
    pieces = PieceCache(
        lambda text: array(kind, tokenizer.encode(text, add_special_tokens=False).ids).tobytes(),
        ODD_PIECES,
        encode_piece=lambda piece: array(kind, of_piece(piece)).tobytes(),
    )
    return WordCache(word_ids(tokenizer, kind) if plain else None, pieces.encode)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or nothing if there are too few samples to train one."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def pack_block(rows: list[tuple[int | None, int, bytes]], width: int, dictionary_hash: bytes) -> bytes:
    """``rows`` of (doc_id, ids, frame)."""
    starts = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype("<i8")
    return b"".join([
        b"TIDS", bytes([1, width, 0, 0]), dictionary_hash, len(rows).to_bytes(4, "little"),
        np.array([r[0] or 0 for r in rows], "<i8").tobytes(), bytes(r[0] is None for r in rows),
        np.array([r[1] for r in rows], "<i8").tobytes(), starts.tobytes(), *[r[2] for r in rows],
    ])


class Block:
    """A read block; ``document_at(i)`` gives the ids of one document as unsigned 32-bit integers."""

    def __init__(self, image: bytes, dictionaries: dict[bytes, bytes]):
        if image[:4] != b"TIDS" or image[4] != 1:
            raise ValueError("this is no block of token ids")
        self.width, self.hash = image[5], image[8:40]
        n = self.n = int.from_bytes(image[40:44], "little")
        at = 44
        ids = np.frombuffer(image, "<i8", n, at)
        null = np.frombuffer(image, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.counts = np.frombuffer(image, "<i8", n, at + 9 * n)
        self.starts = np.frombuffer(image, "<i8", n + 1, at + 17 * n)
        self.frames, self.image = at + 25 * n + 8, image
        self.reader = _decompressor(dictionaries[self.hash] if any(self.hash) else b"")

    def document_at(self, i: int) -> np.ndarray:
        frame = self.image[self.frames + int(self.starts[i]) : self.frames + int(self.starts[i + 1])]
        return np.frombuffer(self.reader.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")


@functools.lru_cache(maxsize=4)
def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Write ``docs(doc_id, text)`` as blocks in ascending doc_id order (nulls first) under ``folder``.

    A null text is written as no ids but the end id.  Rows with equal doc_ids
    follow each other.  Other columns are ignored.  Documents are dealt by
    ranges of doc_id, so files and the blocks in them are in order.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = rows.where(F.length("text").between(1, DICTIONARY_CHARS) & F.col("doc_id").isNotNull())
    # Ids alone are ranked, so that no partition sends texts; then few short texts come to the driver.
    chosen = short.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(DICTIONARY_DOCS)
    chosen = short.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("_id"), "left_semi").orderBy("doc_id", "text").limit(DICTIONARY_DOCS)
    keep, width = encoder(path), id_width(path)
    samples = keep.encode_column(pa.array([r[0] for r in chosen.select("text").collect()], pa.string()))
    dictionary = train_dictionary(samples)
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    spark.createDataFrame([(bytearray(digest), bytearray(dictionary))], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches):
        keep, part = encoder(path), TaskContext.get().partitionId()
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=True)
        held, size, block = [], 0, 0

        def packed():
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "docs": len(held), "tokens": sum(r[1] for r in held), "image": pack_block(held, width, digest)}], schema=kinds)

        for batch in batches_of(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), keep.encode_column(batch.column("text"))):
                ids += END_ID.to_bytes(width, "little")
                frame = press.compress(ids)
                held.append((doc_id, len(ids) // width, frame))
                size += len(frame) + 25
                if size >= BLOCK_BYTES:
                    yield packed()
                    held, size, block = [], 0, block + 1
        if held:
            yield packed()

    kinds = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("image", pa.binary())])
    order = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    order.mapInArrow(run, "part int, block int, docs long, tokens long, image binary").write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, position, n_bytes) of each document in the files under ``folder``.

    ``start`` counts the ids of all documents before, from the totals of files
    and blocks; only those totals are summed in order, a row for each block.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    dictionaries = {bytes(r[0]): bytes(r[1]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}

    def run(batches):
        for batch in batches:
            for part, number, image in zip(batch.column("part"), batch.column("block"), batch.column("image")):
                block = Block(image.as_py(), dictionaries)
                crcs = [zlib.crc32(block.document_at(i).tobytes()) for i in range(block.n)]
                before = np.concatenate([[0], np.cumsum(block.counts)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * block.n, pa.int32()), pa.array([number.as_py()] * block.n, pa.int32()), pa.array(block.doc_ids, pa.int64()), pa.array(before, pa.int64()), pa.array(block.counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(np.arange(block.n)), pa.array(np.diff(block.starts), pa.int64())],
                    ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32", "at", "n_bytes"],
                )

    totals = blocks.select("part", "block", "tokens")
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    # One row for each file: as few as the write had tasks.
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("part_start"))
    offsets = totals.select("part", "block", (F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")).alias("block_start")).join(parts, "part")
    read = blocks.select("part", "block", "image").mapInArrow(run, "part int, block int, doc_id long, before long, n_tokens long, ids_crc32 long, at long, n_bytes long")
    return read.join(offsets, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "n_bytes"
    )


def op5(spark, sf_dir):
    import uuid

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder)
