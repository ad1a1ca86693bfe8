"""Product-quantised vector codes from Hilbert-sorted flat blocks.

Vectors become integers (``floor(scale * x)``) and are cut into equal parts;
each part position has a codebook, refined by rounds of exact integer k-means.

Layout: a task packs its vectors into chunks of ``CHUNK_VALUES`` components. In
a chunk, each part's pieces are sorted along a Hilbert curve and cut into flat
blocks of ``BLOCK`` pieces; a block holds the least and greatest value of every
component (its box) and the sum of its pieces. Chunks are written once, so the
rounds neither sort nor shuffle vectors.

A round goes block by block. An entry stays on a block's shortlist if its least
distance to the box is no greater than the smallest of the entries' greatest
ones, and if some corner of the box is no nearer to the entry closest to the
box's middle. One entry left: the whole block is its, and the stored sum is
added without reading a piece. More: an integer kernel takes the exact squared
distances to the entries listed. A task returns one row per part and entry
used; the codebook (parts x entries) is all that reaches the driver.

Memory: one Arrow batch of chunks per task. Nothing depends on how labels, ids
or equal vectors are spread.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; neither do vectors of another length than the one of
the smallest vec_id (null last, then by components). A length that the parts do
not divide is filled up with zeros. Scaled components are held within ±2**28.
Repeated rows count as often as they occur. Fewer rows than entries give
smaller codebooks. Rows with a null vec_id are encoded. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.shared import Scratch, concat_batches, doc_columns

BLOCK = 32
CHUNK_VALUES = 65_536
LIMIT = 1 << 28        # of a scaled component: squared distances fit 64 bits
MOST_LABELS = 100_000  # label sums are broadcast up to here, joined beyond
_BITS = 4              # of a component, in Hilbert keys

_CHUNK = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
                    ("values", pa.binary()), ("orders", pa.binary()), ("lows", pa.binary()),
                    ("highs", pa.binary()), ("sums", pa.binary())])
_CHUNK_DDL = ("ids array<long>, labels array<string>, values binary, orders binary, lows binary, "
              "highs binary, sums binary")
_PARTIAL = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()),
                      ("total", pa.list_(pa.int64()))])
_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()),
                    ("error", pa.int64())])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of every row of ``cells`` (unsigned, below 2**bits) along a
    Hilbert curve; with over 64 bits in all, of its first components."""
    dims = max(1, min(cells.shape[1], 64 // bits))
    x = cells[:, :dims].T.astype(np.uint64)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):     # turn the sub-cubes into one frame
        mask, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for axis in x:
            flip = (axis & mask) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            axis ^= swap
    for i in range(1, dims):               # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << bit)) != 0, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << one) | ((axis >> np.uint64(bit)) & one)
    return key


class Blocks(NamedTuple):
    """One part of one chunk: pieces in Hilbert order, their rows, and the blocks."""
    pieces: np.ndarray   # (rows, width)
    order: np.ndarray    # (rows,) row of each piece in the chunk
    low: np.ndarray      # (blocks, width)
    high: np.ndarray
    total: np.ndarray


def starts_of(rows: int) -> np.ndarray:
    return np.arange(0, rows, BLOCK)


def build_blocks(pieces: np.ndarray) -> Blocks:
    mean, spread = pieces.mean(0), pieces.std(0) + 1
    cells = np.clip((pieces - mean + 2 * spread) / (4 * spread) * (1 << _BITS), 0, (1 << _BITS) - 1)
    order = np.argsort(hilbert_keys(cells.astype(np.uint64), _BITS), kind="stable")
    sorted_pieces, starts = pieces[order], starts_of(len(pieces))
    return Blocks(sorted_pieces, order, np.minimum.reduceat(sorted_pieces, starts),
                  np.maximum.reduceat(sorted_pieces, starts), np.add.reduceat(sorted_pieces, starts))


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether an entry may be nearest to a point of the box,
    or tie with the nearest."""
    def squares(diff):
        return (diff * diff).sum(-1)
    below, above = low[:, None] - book, book - high[:, None]
    least = squares(np.maximum(np.maximum(below, above), 0))
    greatest = squares(np.maximum(np.abs(below), np.abs(above)))
    listed = least <= greatest.min(1)[:, None]
    # against the entry nearest to the middle, at the corner that favours the other
    # entry most: squared distances differ by a linear function of the point
    rival = book[squares(((low + high) // 2)[:, None] - book).argmin(1)][:, None]
    corner = np.where(book > rival, high[:, None], low[:, None])
    return listed & (squares(corner - book) <= squares(corner - rival))


def assign(blocks: Blocks, book: np.ndarray, need_errors: bool):
    """(entry per piece, squared distance per piece or None, sums, counts) with
    the nearest entry, ties to the lower index. Errors need every distance."""
    rows, width = blocks.pieces.shape
    sizes = np.diff(np.append(starts_of(rows), rows))
    listed = shortlists(blocks.low, blocks.high, book)
    only = listed.sum(1) == 1
    entry = np.repeat(np.where(only, listed.argmax(1), 0), sizes)
    total, count = np.zeros((len(book), width), np.int64), np.zeros(len(book), np.int64)
    np.add.at(total, listed[only].argmax(1), blocks.total[only])
    np.add.at(count, listed[only].argmax(1), sizes[only])

    open_rows = np.flatnonzero(np.repeat(~only, sizes))
    best = np.full(rows, np.iinfo(np.int64).max)
    per_row = np.repeat(listed, sizes, axis=0)
    for e, point in enumerate(book):  # ascending, so equal distances keep the lower entry
        hit = np.flatnonzero(per_row[:, e]) if need_errors else open_rows[per_row[open_rows, e]]
        if len(hit):
            diff = blocks.pieces[hit] - point
            d = np.einsum("ij,ij->i", diff, diff)
            nearer = d < best[hit]
            best[hit[nearer]], entry[hit[nearer]] = d[nearer], e
    if len(open_rows):
        np.add.at(total, entry[open_rows], blocks.pieces[open_rows])
        count += np.bincount(entry[open_rows], minlength=len(book))
    return entry, best if need_errors else None, total, count


def _scaled(column: pa.Array, scale: int, width: int) -> np.ndarray:
    flat = column.values.slice(column.offsets[0].as_py(),
                               column.offsets[-1].as_py() - column.offsets[0].as_py())
    x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    x = np.clip(x, -LIMIT, LIMIT).astype(np.int64).reshape(len(column), -1)
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _pack(parts: int, width: int, scale: int):
    """Rows (vec_id, label, v) to chunk rows; ``width`` components per part."""
    chunk_rows = max(BLOCK, CHUNK_VALUES // (parts * width))

    def chunk(x, ids, labels):
        blocks = [build_blocks(x[:, p * width:(p + 1) * width]) for p in range(parts)]

        def join(field, kind):
            return b"".join(getattr(b, field).astype(kind).tobytes() for b in blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], _CHUNK.field(0).type), pa.array([labels], _CHUNK.field(1).type),
             pa.array([join("pieces", "<i4")]), pa.array([join("order", "<i4")]),
             pa.array([join("low", "<i4")]), pa.array([join("high", "<i4")]),
             pa.array([join("total", "<i8")])], schema=_CHUNK)

    def run(batches):
        held, ids, labels = [], [], []
        for b in batches:
            if b.num_rows:
                held.append(_scaled(b.column(2), scale, parts * width))
                ids += b.column(0).to_pylist()
                labels += b.column(1).to_pylist()
            while len(ids) >= chunk_rows:
                x = np.concatenate(held)
                yield chunk(x[:chunk_rows], ids[:chunk_rows], labels[:chunk_rows])
                held, ids, labels = [x[chunk_rows:]], ids[chunk_rows:], labels[chunk_rows:]
        if ids:
            yield chunk(np.concatenate(held), ids, labels)
    return run


def _unpack(batch: pa.RecordBatch, row: int, parts: int, width: int) -> list[Blocks]:
    rows = len(batch.column(0)[row])
    blocks = len(starts_of(rows))

    def field(i, kind, shape):
        return np.frombuffer(batch.column(i)[row].as_buffer(), kind).astype(np.int64).reshape(shape)
    shape = (parts, blocks, width)
    columns = (field(2, "<i4", (parts, rows, width)), field(3, "<i4", (parts, rows)),
               field(4, "<i4", shape), field(5, "<i4", shape), field(6, "<i8", shape))
    return [Blocks(*(c[p] for c in columns)) for p in range(parts)]


def _partial_sums(books: list[np.ndarray], width: int):
    def run(batches):
        totals = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            for row in range(b.num_rows):
                for p, blocks in enumerate(_unpack(b, row, len(books), width)):
                    _, _, total, count = assign(blocks, books[p], False)
                    totals[p] += total
                    counts[p] += count
        out = [(p, e, int(n), totals[p][e].tolist())
               for p in range(len(books)) for e, n in enumerate(counts[p]) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], _PARTIAL.field(i).type) for i in range(4)], schema=_PARTIAL)
    return run


def _encode(books: list[np.ndarray], width: int):
    digits = max(2, len(f"{max(len(b) for b in books) - 1:x}"))

    def rows(batches):
        for b in batches:
            for row in range(b.num_rows):
                ids, labels = b.column(0)[row].values, b.column(1)[row].values
                codes = np.zeros((len(ids), len(books)), np.int64)
                error = np.zeros(len(ids), np.int64)
                for p, blocks in enumerate(_unpack(b, row, len(books), width)):
                    entry, best, _, _ = assign(blocks, books[p], True)
                    codes[blocks.order, p] = entry
                    error[blocks.order] += best
                text = ["".join(f"{c:0{digits}x}" for c in row_codes) for row_codes in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(text, pa.string()), pa.array(error)], schema=_CODES)
    return lambda batches: concat_batches(rows(batches), _CODES)


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label (as text), v of the vectors without gaps."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (doc_columns(table, "vec_id", "label", "embedding")
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("label").cast("string").alias("label"),
                    F.col("embedding").cast("array<double>").alias("v"))
            .where(v.isNotNull() & (F.size(v) > 0)).where(whole))


class Codes(NamedTuple):
    rows: DataFrame              # vec_id, label, code, error
    books: list[np.ndarray]      # per part: (entries, width) integers
    scratch: Scratch | None


def encode_vectors(spark: SparkSession, table: DataFrame, parts: int = 8, entries: int = 16,
                   rounds: int = 6, scale: int = 4096) -> Codes:
    """Codes of every usable vector and the final codebooks."""
    if parts < 1 or entries < 1 or rounds < 0:
        raise ValueError("parts and entries are 1 at least, rounds 0 at least")
    scratch = Scratch(spark, "codes")
    kept = usable(table)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], "vec_id long, label string, code string, error long")
        return Codes(empty, [], None)
    dim = len(first[0].v)
    width = -(-dim // parts)
    kept = kept.where(F.size("v") == dim)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    seed = _scaled(pa.array([r.v for r in seeds], pa.list_(pa.float64())), scale, parts * width)
    books = [seed[:, p * width:(p + 1) * width] for p in range(parts)]

    packed = kept.mapInArrow(_pack(parts, width, scale), _CHUNK_DDL)
    packed.write.option("parquet.block.size", 16 << 20).parquet(scratch.path("chunks"))
    chunks = spark.read.schema(packed.schema).parquet(scratch.path("chunks"))
    for _ in range(rounds):
        sums = (chunks.mapInArrow(_partial_sums(books, width),
                                  "part int, entry int, n long, total array<long>")
                .groupBy("part", "entry")
                .agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)])
                     .alias("total")))
        books = [b.copy() for b in books]
        for r in sums.collect():  # one row per part and entry used
            books[r.part][r.entry] = [t // r.n for t in r.total]
    rows = scratch.save(chunks.mapInArrow(_encode(books, width),
                                          "vec_id long, label string, code string, error long"), "codes")
    scratch.drop("chunks")
    return Codes(rows, books, scratch)


def books_digest(books: list[np.ndarray]) -> str:
    text = ",".join(str(c) for b in books for e in b.tolist() for c in e)
    return hashlib.sha256(text.encode()).hexdigest()


def compressed(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) with the defaults."""
    codes = encode_vectors(spark, table)
    per_label = codes.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    if codes.scratch is not None:
        per_label = codes.scratch.save(per_label, "labels")
        if per_label.count() <= MOST_LABELS:
            per_label = F.broadcast(per_label)
    per_label = per_label.withColumnRenamed("label", "of")
    return (codes.rows.join(per_label, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error",
                    F.lit(books_digest(codes.books)).alias("codebooks_sha256")))


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """DuckDB SQL for ``compressed``: plain k-means, one pair of CTEs a round."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT r, p, any_value(x.s) AS s,
    min(list_sum([(x.s[j] - c.s[j]) * (x.s[j] - c.s[j]) FOR j IN range(1, len(x.s) + 1)])::HUGEINT
        * {entries} + e) AS m
  FROM parts x JOIN c{i} c USING (p) GROUP BY r, p)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(u.s, c.s) AS s FROM c{i} c LEFT JOIN (
    SELECT p, e, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY j) AS s FROM (
      SELECT p, (m % {entries})::BIGINT AS e, j, sum(s[j]) AS t, count(*) AS n
      FROM a{i}, unnest(range(1, len(s) + 1)) AS js(j) GROUP BY ALL)
    GROUP BY p, e) u ON u.p = c.p AND u.e = c.e)"""
    steps = []
    for i in range(rounds + 1):
        steps.append(nearest.format(i=i, entries=entries))
        if i < rounds:
            steps.append(moved.format(i=i, n=i + 1, entries=entries))
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS s
  FROM k, range({parts}) AS ps(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, s FROM parts WHERE r <= {entries}),
{(',' + chr(10)).join(steps)},
o AS (SELECT r, string_agg(printf('%02x', (m % {entries})::BIGINT), '' ORDER BY p) AS code,
        sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(s[j]::VARCHAR, ',' ORDER BY p, e, j)) AS digest
      FROM c{rounds}, unnest(range(1, len(s) + 1)) AS js(j))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  digest AS codebooks_sha256
FROM k JOIN o USING (r), h"""
