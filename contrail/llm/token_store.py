"""Token ids as directly addressable codes (DACs) in seekable files.

An id is cut into byte chunks, lowest first. Level 0 holds the first chunk of
every token, level l the chunk of the tokens that need one more; a level's
continuation bitmap says which of its tokens go on, and its rank directory
(ones before every 512th bit) gives a token's place on the next level. So any
token is read by touching one byte and one bitmap block per level, with no
block decoding. A document of consecutive tokens is a slice on every level.

A segment file (``.dac``): magic, header length, JSON header with section
offsets, then sections aligned to 8 bytes: doc ids, doc id validity, document
starts (tokens), and per level chunks, bitmap and rank directory. Files are
written under a private name and moved into place, so a task that is retried
or runs twice leaves one whole file. A manifest table lists the segments in
ascending doc_id order with their first token's global position.

The folder must be reachable by ``pyarrow.fs`` from every executor (a shared
mount, HDFS, S3, GCS); other schemes raise an error.

Defined results: null text is empty and holds only the end id; rows with
equal doc_id keep the order of their texts; null doc_ids come first; an empty
table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.shared import Scratch, binary_values, doc_columns
from contrail.llm.word_encoder import encoder

MAGIC = b"CDAC0001"
RANK_BITS = 512            # bits per rank directory entry
SEGMENT_TOKENS = 2_000_000  # a segment is closed once it holds so many

_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


# ---- the format --------------------------------------------------------------

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank directory) of every level, for uint32 ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk = rest.astype(np.uint8)
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-max(len(more), 1) // RANK_BITS) * RANK_BITS, bool)
        padded[:len(more)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(1)
        rank = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        levels.append((chunk, bitmap, rank))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


def segment_bytes(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment file: documents ``doc_ids`` (None allowed), document k's
    tokens being ids[starts[k]:starts[k + 1]]."""
    sections = [("doc_ids", np.array([0 if d is None else d for d in doc_ids], "<i8")),
                ("doc_valid", np.array([d is not None for d in doc_ids], np.uint8)),
                ("starts", starts.astype("<u8"))]
    levels = encode_levels(ids)
    for i, (chunk, bitmap, rank) in enumerate(levels):
        sections += [(f"chunks{i}", chunk), (f"bitmap{i}", bitmap), (f"rank{i}", rank.astype("<u4"))]
    header: dict = {"docs": len(doc_ids), "tokens": len(ids), "levels": len(levels), "at": {}}
    at, body = 0, []
    for name, data in sections:
        raw = data.tobytes()
        header["at"][name] = [at, len(raw)]
        pad = -len(raw) % 8
        body += [raw, b"\0" * pad]
        at += len(raw) + pad
    head = json.dumps(header).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


class TokenSegment:
    """Random access to one segment held in a buffer (or a memory map)."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token segment")
        size = int.from_bytes(view[8:12], "little")
        header = json.loads(bytes(view[12:12 + size]))
        base = 12 + size

        def section(name, kind):
            at, length = header["at"][name]
            return np.frombuffer(view[base + at:base + at + length], kind)

        self.n_docs, self.n_tokens = header["docs"], header["tokens"]
        self.doc_ids = section("doc_ids", "<i8")
        self.doc_valid = section("doc_valid", np.uint8).astype(bool)
        self.starts = section("starts", "<u8").astype(np.int64)
        self._levels = [(section(f"chunks{i}", np.uint8), section(f"bitmap{i}", np.uint8),
                         section(f"rank{i}", "<u4")) for i in range(header["levels"])]

    def _rank(self, level: int, at: int) -> int:
        """Ones before bit ``at`` of a level's bitmap."""
        _, bitmap, rank = self._levels[level]
        block = at // RANK_BITS
        first, last = block * RANK_BITS // 8, at // 8
        ones = int(np.bitwise_count(bitmap[first:last]).sum())
        if at % 8:
            ones += (int(bitmap[last]) & ((1 << at % 8) - 1)).bit_count()
        return int(rank[block]) + ones

    def token(self, at: int) -> int:
        """The id of one token."""
        if not 0 <= at < self.n_tokens:
            raise IndexError(at)
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            value |= int(chunks[at]) << 8 * level
            if not bitmap[at >> 3] >> (at & 7) & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids of a range of tokens."""
        start, stop = max(0, start), min(stop, self.n_tokens)
        out = np.zeros(max(0, stop - start), np.uint32)
        where = np.arange(len(out))
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            if start >= stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[start // 8:-(-stop // 8)], bitorder="little")
            where = where[bits[start % 8:start % 8 + stop - start].astype(bool)]
            start = self._rank(level, start)
            stop = start + len(where)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


# ---- tasks -------------------------------------------------------------------

def _filesystem(folder: str):
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        folder = os.path.abspath(folder)
    elif folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder[len("file:"):]
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, data: bytes) -> str:
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    private = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(private) as out:
        out.write(data)
    store.move(private, f"{path}/{name}")
    return name


def _encode(folder: str, tokenizer: str, end_id: int):
    def task(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        pieces: list[bytes] = []
        held = 0

        def close():
            nonlocal doc_ids, pieces, held, seq
            starts = np.concatenate(([0], np.cumsum([len(p) // 4 for p in pieces]))).astype(np.int64)
            ids = np.frombuffer(b"".join(pieces), "<u4")
            name = _write(folder, f"segment-{part:06d}-{seq:06d}.dac",
                          segment_bytes(doc_ids, starts, ids))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "path": [name], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]})
            doc_ids, pieces, held, seq = [], [], 0, seq + 1
            return row

        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_pylist()
            for doc_id, data in zip(ids, encode(binary_values(b.column(1)))):
                doc_ids.append(doc_id)
                pieces.append(data + end)
                held += len(data) // 4 + 1
                if held >= SEGMENT_TOKENS:
                    yield close()
        if doc_ids:
            yield close()
    return task


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                   ("ids_crc32", pa.int64())])


def _read(folder: str):
    def task(batches):
        store, path = _filesystem(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{path}/{name}") as f:
                    seg = TokenSegment(f.read())
                ids = seg.tokens(0, seg.n_tokens).astype("<u4").tobytes()
                at = (seg.starts * 4).tolist()
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, mask=~seg.doc_valid), pa.array(seg.starts[:-1] + first),
                     pa.array(np.diff(seg.starts)), pa.array(crc, pa.int64())], schema=_DOCS)
    return task


# ---- the operator ------------------------------------------------------------

def write_store(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str,
                end_id: int) -> DataFrame:
    """Encode every text and write its ids, ``end_id`` appended, as segments
    in ascending doc_id order. Returns the manifest: part, seq, path, n_docs,
    n_tokens, first (global position of the segment's first token)."""
    ordered = (doc_columns(docs, "doc_id", "text")
               .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    parts = ordered.mapInArrow(_encode(folder, tokenizer, end_id), _MANIFEST)
    parts.write.mode("overwrite").parquet(f"{folder}/manifest-parts")
    # one row per segment of SEGMENT_TOKENS tokens: a short table to order
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest-parts").withColumn(
        "first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(f"{_MANIFEST}, first long").parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store."""
    manifest = spark.read.schema(f"{_MANIFEST}, first long").parquet(f"{folder}/manifest")
    spread = manifest.select("path", "first").repartition(max(1, manifest.count()))
    return spread.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int,
                folder: str | None = None) -> DataFrame:
    """Write a store (below the shared scratch folder by default), read it back."""
    scratch = Scratch(spark, "tokens")
    folder = folder or scratch.path("store")
    write_store(spark, docs, folder, tokenizer, end_id)
    return read_documents(spark, folder)
