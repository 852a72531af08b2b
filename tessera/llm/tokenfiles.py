"""Token ids in binary files: every document a zstandard frame of its own, all under one trained dictionary.

A shard is: MAGIC, the bytes of an id (2 or 4), the sha256 of the dictionary; the frames; the index (ids of documents and
which of them are null, ids before each document in the shard, where its frame begins); where the index begins, its
crc32, the number of documents, MAGIC. All numbers are little-endian. The dictionary is a file of its own. The table
``manifest`` names the shards that were committed, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small, texts

MAGIC = b"TOKSHRD1"
HEAD, TAIL = "<8sB32s", "<QIQ8s"
HEAD_SIZE, TAIL_SIZE = struct.calcsize(HEAD), struct.calcsize(TAIL)
MANIFEST = "file string, part int, place int, docs long, tokens long, before long, first_id long, last_id long, has_null boolean, bytes long"
#: Bytes of frames, and documents, after which a task begins another shard.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 18
#: Words, and pieces of words, whose ids a Python worker remembers at most (or those of one batch).
REMEMBER = 700_000


def open_store(uri: str):
    """The pyarrow file system of a folder and its path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


#: Letters whose runs a word is cut into, and what may not follow such a run: a mark or letter that would belong to it.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
PIECE = f"{LETTERS}++(?![^\\x00-\\x7f])|.+"


class Encoder:
    """Texts to packed ids by a tokenizer file; ``end`` is appended to each text.

    ``by_word``: the tokenizer drops white space and puts runs of letters and of other characters apart, so the ids of a
    text are those of its words one after another, and a word's those of the letters it begins with and of its rest. Ids
    of words and pieces seen before are remembered (REMEMBER words at most; that changes the time only). Runs of letters
    go to the library's merges right away, as the library itself normalises each of the letters."""

    def __init__(self, tokenizer: str, end: int, by_word: bool):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(tokenizer)
        self.width = 2 if max(self.of.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.by_word, self.known, self.pieces, self.cut = by_word, {}, {}, re.compile(PIECE, re.DOTALL).findall
        self.end, self.run, self.merge = self._packed([end]), re.compile(f"{LETTERS}+").fullmatch, self.of.model.tokenize
        if by_word:
            letters = [chr(i) for i in range(256) if self.run(chr(i))]
            self.specials = [x.content.encode() for x in self.of.get_added_tokens_decoder().values()]
            self.form = str.maketrans({c: "".join(x for x, _ in self.of.pre_tokenizer.pre_tokenize_str(self.of.normalizer.normalize_str(c))) for c in letters})
            # Where the tokenizer makes all letters small itself, that is done to A-Z first: fewer words are distinct.
            self.lowers = all(self.form[ord(c)] == c.lower() for c in letters if c.isascii())

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _ids(self, data: list[str]) -> list[bytes]:
        return [self._packed(x.ids) for x in self.of.encode_batch_fast(data, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """A call of the library costs more than a word, so all new pieces that aren't letters go to it at once."""
        pieces, cuts = self.pieces, [[w.decode()] if w.isalpha() else self.cut(w.decode()) for w in words]  # bytes: A-Z, a-z
        new = set().union(*cuts).difference(pieces) if cuts else set()
        if len(pieces) + len(new) > REMEMBER:
            pieces.clear()
            new = set().union(*cuts)
        other, merge, form, lowers = [], self.merge, self.form, self.lowers
        for x in new:
            if x.isascii() and x.isalpha() and lowers:
                pieces[x] = self._packed([t.id for t in merge(x.lower())])
            elif self.run(x):
                pieces[x] = self._packed([t.id for t in merge(x.translate(form))])
            else:
                other.append(x)
        pieces.update(zip(other, self._ids(other)))
        self.known.update((w, pieces[cut[0]] if len(cut) == 1 else b"".join([pieces[x] for x in cut])) for w, cut in zip(words, cuts))

    def _small(self, text: bytes) -> bytes:
        """Special tokens are told by their case, so a text with their first characters stays as it is."""
        return text.lower() if self.lowers and not any(x[:2] in text for x in self.specials) else text

    def encode(self, data: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [ids + self.end for ids in self._ids([t.decode() for t in data])]
        split = [self._small(t).split() for t in data]  # bytes: at ASCII white space, A-Z
        have = set().union(*split)
        if len(self.known) + len(have) > REMEMBER:
            self.known.clear()
        self._learn(list(have.difference(self.known)))
        get = self.known.__getitem__
        return [b"".join([*map(get, words), self.end]) for words in split]


def encoder_of(tokenizer: str, end: int, by_word: bool) -> Encoder:
    """One encoder for all tasks of a Python worker. This module comes to a worker anew with each task, the library's stays."""
    import tokenizers

    kept, key = tokenizers.__dict__.setdefault("_kept", {}), (tokenizer, end, by_word)
    if key not in kept:
        kept[key] = Encoder(*key)
    return kept[key]


def _quiet() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, by_word: bool, size: int, sample_docs: int, sample_ids: int) -> bytes:
    """A zstandard dictionary of ``size`` bytes from the ids of about ``sample_docs`` documents, taken by the hash of id
    and text from all; of a longer document ``sample_ids`` ids from a place that the hash tells. It bears on the size of
    the files alone. Too little to train from: the ids themselves are the dictionary; no ids: it is empty."""
    import zstandard

    n = docs.count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    chosen = docs.select("doc_id", "text", h.alias("h")).where(F.col("h") < min(2**63 - 1, 2**64 * sample_docs // max(n, 1)))
    chosen = chosen.orderBy("h").limit(sample_docs)

    def run(batches):
        import pyarrow as pa

        _quiet()
        encoder = encoder_of(tokenizer, end, by_word)
        for b in small(batches, 200):
            parts = []
            for ids, at in zip(encoder.encode(texts(b)), b.column(b.schema.get_field_index("h")).to_pylist()):
                most = sample_ids * encoder.width
                begin = at % max(1, (len(ids) - most) // encoder.width) * encoder.width if len(ids) > most else 0
                parts.append(ids[begin : begin + most])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("h")), pa.array(parts, pa.binary())], ["h", "ids"])

    rows = chosen.repartition(min(partitions(docs.sparkSession), 32), "h").mapInArrow(run, "h long, ids binary").collect()
    samples = [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.h, bytes(r.ids)))]
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


class ShardWriter:
    """One shard; ``close`` returns its row of the manifest but for part, place and what comes before."""

    def __init__(self, folder: str, name: str, width: int, dictionary: bytes):
        import zstandard

        self.store, path = open_store(folder)
        self.name, self.out = name, self.store.open_output_stream(f"{path}/{name}")
        known = _dictionary(dictionary)
        if known:
            known.precompute_compress(level=3)
        self.squeeze = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True).compress if known else zstandard.ZstdCompressor(level=3).compress
        self.width, self.ids, self.tokens, self.starts = width, [], [0], [HEAD_SIZE]
        self.out.write(struct.pack(HEAD, MAGIC, width, hashlib.sha256(dictionary).digest()))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.squeeze(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.tokens.append(self.tokens[-1] + len(ids) // self.width)
        self.starts.append(self.starts[-1] + len(frame))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.starts[-1] >= SHARD_BYTES

    def close(self) -> dict:
        known = [i for i in self.ids if i is not None]
        null = np.array([i is None for i in self.ids], np.uint8)
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.tokens, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index)
        self.out.write(struct.pack(TAIL, self.starts[-1], zlib.crc32(index), len(self.ids), MAGIC))
        size = self.out.tell()
        self.out.close()
        return {"file": self.name, "docs": len(self.ids), "tokens": self.tokens[-1], "first_id": min(known, default=None), "last_id": max(known, default=None), "has_null": len(known) < len(self.ids), "bytes": size}


class ShardReader:
    """Any document of a shard from the index and its own frame."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        import zstandard

        store, path = open_store(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        magic, self.width, said = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        size = self.file.size()
        at, crc, n, again = struct.unpack(TAIL, self.file.read_at(TAIL_SIZE, size - TAIL_SIZE))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{name} is no shard of token ids")
        if said != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        index = self.file.read_at(size - TAIL_SIZE - at, at)
        if zlib.crc32(index) != crc:
            raise ValueError(f"the index of {name} is damaged")
        self.ids, null = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.null, self.tokens = null.astype(bool), np.frombuffer(index[9 * n :], "<u8", n + 1)
        self.starts = np.frombuffer(index[9 * n + 8 * (n + 1) :], "<u8", n + 1)
        known = _dictionary(dictionary)
        self.expand = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        begin, end = int(self.starts[i]), int(self.starts[i + 1])
        return np.frombuffer(self.expand(self.file.read_at(end - begin, begin)), f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1, by_word: bool = False, dictionary_bytes: int = 1 << 16, sample_docs: int = 2_000, sample_ids: int = 2_048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts (null: empty), each followed by ``end``, in ascending order of document ids (null first;
    rows with the same id in the order of their texts' hashes) to shards in the folder ``path``; the manifest is returned.

    Documents are dealt out by ranges of id, hash and place, so an id that very many rows have is no task of its own, and
    sorted within. A task holds one document's ids and a shard's index at a time. No documents: a manifest without rows.
    Other columns are not read. A folder that exists already is an error."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(docs, tokenizer, end, by_word, dictionary_bytes, sample_docs, sample_ids)
    store, folder = open_store(path)
    if store.get_file_info(folder).type.name != "NotFound":
        raise FileExistsError(path)
    store.create_dir(f"{folder}/shards", recursive=True)
    with store.open_output_stream(f"{folder}/dictionary") as f:
        f.write(dictionary)
    shards = f"{path}/shards"

    def run(batches):
        import pyarrow as pa

        _quiet()
        encoder, part = encoder_of(tokenizer, end, by_word), TaskContext.get().partitionId()
        writer, place, before = None, 0, 0

        def finish():
            nonlocal writer, place, before
            row = writer.close() | {"part": part, "place": place, "before": before}
            writer, place, before = None, place + 1, before + row["tokens"]
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("before", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()), ("bytes", pa.int64())])
        for b in small(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(texts(b))):
                if writer is None:
                    writer = ShardWriter(shards, f"{part:06d}-{place:06d}-{uuid.uuid4().hex}.ids", encoder.width, dictionary)
                writer.add(doc_id, ids)
                if writer.full():
                    yield finish()
        if writer:
            yield finish()

    tie = F.xxhash64("text")
    ranged = docs.withColumns({"h": tie, "at": F.monotonically_increasing_id()}).repartitionByRange(partitions(spark), "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    ranged.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def dictionary_of(path: str) -> bytes:
    store, folder = open_store(path)
    with store.open_input_file(f"{folder}/dictionary") as f:
        return f.read()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids``: every document of the files, ``start`` the number of ids before it, ``ids`` as unsigned
    32-bit little-endian numbers. A task reads a shard's index, then frame by frame. What comes before a part is summed
    from one row a part on the driver."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    parts = sorted((r.part, r.tokens) for r in manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect())
    bases, total = [], 0
    for part, tokens in parts:
        bases.append((part, total))
        total += tokens
    files = manifest.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select("file", (F.col("base") + F.col("before")).alias("start"))
    dictionary, shards = dictionary_of(path), f"{path}/shards"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                shard = ShardReader(shards, r["file"], dictionary)
                rows, held = ([], [], []), 0

                def out(rows):
                    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["doc_id", "start", "ids"])

                for i in range(len(shard)):
                    ids = shard.document(i).astype("<u4").tobytes()
                    for column, value in zip(rows, (None if shard.null[i] else int(shard.ids[i]), r["start"] + int(shard.tokens[i]), ids)):
                        column.append(value)
                    held += len(ids)
                    if held > 4 << 20 or len(rows[0]) >= 2_000:
                        yield out(rows)
                        rows, held = ([], [], []), 0
                if rows[0]:
                    yield out(rows)

    return files.repartition(partitions(spark), "file").mapInArrow(run, "doc_id long, start long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id: of the shards that can have it the index and those frames are read."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "place").toLocalIterator()
    found, dictionary = [], dictionary_of(path)
    for r in rows:
        shard = ShardReader(f"{path}/shards", r.file, dictionary)
        found += [shard.document(int(i)).tolist() for i in np.flatnonzero((shard.ids == doc_id) & ~shard.null)]
    return found
