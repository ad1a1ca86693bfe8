"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, and
the normaliser's switches. From them a ``tokenizers`` model is rebuilt: a
unigram model with the pieces' scores, or a BPE model whose merges follow the
scores; byte fallback, the normaliser's character map, white space clean-up
and the metaspace marker with its dummy prefix. Batches are encoded with the
library's threads; ``verify`` compares the ids with the sentencepiece library's
and decodes them again.

No piece joins a character to a marker that follows it, nor holds a line
break, so where the normaliser is the identity a text is encoded in stretches
cut at these places, each once per memo, many new ones in one text that is cut
at the same places; the loader checks the condition and otherwise whole texts
are encoded. ``verify`` follows the same rule: a stretch is
compared when it is encoded, so once per memo, together with others in one text
that is cut at the same places; a text is like the library's if all its
stretches are. Whole texts are compared where texts are not cut.

Defined results: null and empty texts have no ids and decode to the empty
text; a marker character in a text decodes to a blank, as in the library;
every row gives one row, null doc_ids and repeats included; extra columns are
kept by ``encode`` / ``decode`` and ignored by ``digest``.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.chunks import MEMO_PIECES, PieceEncoder, cut_ids, packed
from contrail.llm.shared import Scratch, doc_columns, tidy

MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2

THREADS = 2  # of the library, per task

_TOGETHER = 4096  # stretches compared in one text
_JOINED = 128     # stretches encoded in one text
_STRETCH = re.compile(r" *[^ \n]+|\n+| +")


# ---- the model file ----------------------------------------------------------

def _fields(data: bytes):
    """(field number, value) pairs of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at:at + size], at + size
        elif kind == 5:
            value, at = data[at:at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class PieceModel:
    """What the encoder needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []  # piece, score, type
        self.kind, self.byte_fallback, self.unk_id = UNIGRAM, False, 0
        self.char_map, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        self.char_map = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        for i, (_, _, kind) in enumerate(self.pieces):
            if kind == UNKNOWN:
                self.unk_id = i
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")

    @property
    def stretches(self) -> bool:
        """Texts may be cut before a marker and around line breaks."""
        inner = re.compile(f"[^{MARK}]{MARK}")
        return (not self.char_map and not self.trim and self.escape and self.dummy_prefix
                and self.kind == BPE and self.byte_fallback
                and not any(kind == USER for _, _, kind in self.pieces)
                and not any(inner.search(p) or len(p) > 1 and "\n" in p
                            for p, _, kind in self.pieces if kind == NORMAL))

    def _merges(self) -> list[tuple[str, str]]:
        usable = {p: (score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        merges = []
        for piece, (score, i) in usable.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    merges.append((-score, i, usable[left][1], usable[right][1], left, right))
        merges.sort()
        return [m[4:] for m in merges]

    def tokenizer(self, prefix: bool):
        """The rebuilt model; ``prefix``: add the dummy prefix to each text."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers
        if self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self._merges(),
                               unk_token=self.pieces[self.unk_id][0], fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            # pieces that never match a text keep their ids but not their string
            vocab = [(p if kind in (NORMAL, USER, BYTE, UNKNOWN) else f"\0{i}", score)
                     for i, (p, score, kind) in enumerate(self.pieces)]
            model = models.Unigram(vocab, self.unk_id, self.byte_fallback)
        tok = Tokenizer(model)
        steps = []
        if self.char_map:
            steps.append(normalizers.Precompiled(self.char_map))
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if prefix and self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if self.dummy_prefix:
            undo.append(decoders.Strip(" ", 1, 0))
        tok.decoder = decoders.Sequence(undo)
        return tok


class Codec:
    """Encoder and decoder of texts for one model; batches are encoded with
    ``threads`` threads (set before the library is first used)."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = PieceModel(data)
        self._cut = self.model.stretches
        library = self.model.tokenizer(not self._cut)
        self._decode = library.decode_batch  # the same with and without the prefix
        self._library = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        # bytes of each id's piece in a text, 0 if it may stand for others
        self._sizes = np.array([1 if kind == BYTE else len(p.encode()) if kind == NORMAL else 0
                                for p, _, kind in self.model.pieces], np.int64)
        self._memo = PieceEncoder(self._coded)

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pieces."""
        if not self._cut:
            return list(map(packed, self._library(pieces)))
        rows = [_in_a_row(pieces[i:i + _JOINED]) for i in range(0, len(pieces), _JOINED)]
        ids: dict[str, bytes] = {}
        for row, coded in zip(rows, self._library(["".join(r) for r in rows])):
            cut = cut_ids(coded, self._sizes, [len(p.replace(" ", MARK).encode()) for p in row])
            ids.update(zip(row, cut if cut is not None else map(packed, self._library(row))))
        return [ids[p] for p in pieces]

    def pieces(self, texts: list[str | None]) -> list[list[str]]:
        """What each text is encoded by: its stretches, or itself."""
        if self._cut:
            # the marker is what blanks become, so a text may as well have the blank
            return [_STRETCH.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        return [[t] if t else [] for t in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._memo(self.pieces(texts))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._decode(ids, skip_special_tokens=False)


class Verifier:
    """A codec whose pieces are checked as they are encoded: ``unlike`` holds
    the ones to which the sentencepiece library gives other ids, ``lost`` the
    ones that do not decode to themselves."""

    def __init__(self, codec: Codec, data: bytes):
        from sentencepiece import SentencePieceProcessor
        self._codec, self._library = codec, SentencePieceProcessor(model_proto=data)
        self._plain = codec._memo._encode
        self._fresh()

    def _fresh(self) -> None:
        self.unlike, self.lost = set(), set()
        self._memo = PieceEncoder(self._checked)

    def __call__(self, texts: list[str | None]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Ids, parity and round trip of each text."""
        if len(self.unlike) + len(self.lost) > MEMO_PIECES:
            self._fresh()
        pieces = self._codec.pieces(texts)
        coded = self._memo(pieces)
        unlike, lost = self.unlike, self.lost
        return (coded, [not unlike or unlike.isdisjoint(p) for p in pieces],
                [(not lost or lost.isdisjoint(p)) and not (t and MARK in t) for p, t in zip(pieces, texts)])

    def _checked(self, pieces: list[str]) -> list[bytes]:
        coded = self._plain(pieces)
        ids = dict(zip(pieces, coded))
        if not self._codec._cut:
            found = [np.frombuffer(c, "<u4").tolist() for c in coded]
            for p, own, theirs, text in zip(pieces, found, self._library.encode(pieces, num_threads=1),
                                            self._codec.decode(found)):
                if theirs != own:
                    self.unlike.add(p)
                if text != p:
                    self.lost.add(p)
            return coded
        frame = [" a", "\n"]
        ids.update(zip(frame, self._plain(frame)))
        for start in range(0, len(pieces), _TOGETHER):
            group = pieces[start:start + _TOGETHER]
            text, joined = self._joined(group, ids)
            for same, bad in ((self._same_ids, self.unlike), (self._same_text, self.lost)):
                if not same(text, joined):
                    self._check(group, ids, same, bad)
        return coded

    def _joined(self, group: list[str], ids: dict) -> tuple[str, list[int]]:
        """A text of the stretches, and its ids from theirs."""
        row = _in_a_row(group)
        return "".join(row)[1:], np.frombuffer(b"".join(map(ids.__getitem__, row)), "<u4").tolist()

    def _check(self, group: list[str], ids: dict, same, bad: set) -> None:
        """Halves a group that differs until the pieces at fault are alone."""
        if same(*self._joined(group, ids)):
            return
        if len(group) == 1:
            bad.add(group[0])
            return
        half = len(group) // 2
        self._check(group[:half], ids, same, bad)
        self._check(group[half:], ids, same, bad)

    def _same_ids(self, text: str, ids: list[int]) -> bool:
        return self._library.encode(text) == ids

    def _same_text(self, text: str, ids: list[int]) -> bool:
        return self._codec.decode([ids])[0] == text


def _in_a_row(stretches: list[str]) -> list[str]:
    """The stretches, with others between them, so that their text is cut into
    just these: words behind blanks follow a word, line breaks stand between
    words, words without blanks follow a break, blanks alone precede one."""
    kinds: dict[str, list[str]] = {"word": [], "break": [], "bare": [], "blank": []}
    for s in stretches:
        kinds["break" if s[0] == "\n" else "bare" if s[0] != " " else
              "blank" if not s.strip(" ") else "word"].append(s)
    row = [" a", *kinds["word"]]
    for s in kinds["break"]:
        row += [s, " a"]
    for s in kinds["bare"]:
        row += ["\n", s]
    for s in kinds["blank"]:
        row += [s, "\n"]
    return row


@lru_cache(maxsize=1)
def worker_verifier(data: bytes) -> Verifier:
    return Verifier(worker_codec(data), data)


@lru_cache(maxsize=1)
def worker_codec(data: bytes) -> Codec:
    """The worker's codec, kept from task to task."""
    return Codec(data)


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, read once on the driver and sent with the tasks."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    spark.sparkContext.addFile(path)
    with open(SparkFiles.get(path.rsplit("/", 1)[1]), "rb") as f:
        return f.read()


# ---- tasks -------------------------------------------------------------------

def _encode(data, column: int):
    def task(batches):
        codec = worker_codec(data.value)
        for b in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in
                   codec.encode(b.column(column).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "ids"])
    return task


def _decode(data, column: int):
    def task(batches):
        codec = worker_codec(data.value)
        for b in batches:
            texts = codec.decode([x or [] for x in b.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())],
                                             names=[*b.schema.names, "decoded"])
    return task


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                     ("parity", pa.bool_()), ("round_trip", pa.bool_())])


def _digest(data, verify: bool):
    def task(batches):
        codec = worker_codec(data.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            if verify:
                coded, parity, same = worker_verifier(data.value)(texts)
            else:
                coded, parity = codec.encode(texts), [None] * len(texts)
                ids = [np.frombuffer(x, "<u4").tolist() for x in coded]
                same = [x == t for x, t in zip(codec.decode(ids), texts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()),
                 pa.array([zlib.crc32(x) for x in coded], pa.int64()),
                 pa.array(parity, pa.bool_()), pa.array(same, pa.bool_())], schema=_DIGEST)
    return task


# ---- the operator ------------------------------------------------------------

def _plain(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def encode(spark: SparkSession, docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with the column ``ids`` (array of int) added at the end, in place
    of a column of that name."""
    Scratch(spark, "pieces")
    docs = docs.drop("ids")
    data = spark.sparkContext.broadcast(model_bytes(spark, model))  # one fixed file
    plain = _plain(docs)
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], "ids array<int>"])
    return (plain.mapInArrow(tidy(_encode(data, docs.columns.index("text"))), fields)
            .toDF(*docs.columns, "ids"))


def decode(spark: SparkSession, coded: DataFrame, model: str) -> DataFrame:
    """``coded`` (with a column ``ids``) with the column ``decoded`` added, in
    place of a column of that name."""
    Scratch(spark, "pieces")
    coded = coded.drop("decoded")
    data = spark.sparkContext.broadcast(model_bytes(spark, model))
    plain = _plain(coded)
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], "decoded string"])
    return (plain.mapInArrow(tidy(_decode(data, coded.columns.index("ids"))), fields)
            .toDF(*coded.columns, "decoded"))


def digest(spark: SparkSession, docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, parity, round_trip): the ids' checksum,
    whether the sentencepiece library gives the same ids (null unless
    ``verify``), and whether decoding gives the text back."""
    Scratch(spark, "pieces")
    data = spark.sparkContext.broadcast(model_bytes(spark, model))
    base = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(tidy(_digest(data, verify)), "doc_id long, n_tokens long, ids_crc32 long, "
                           "parity boolean, round_trip boolean")
