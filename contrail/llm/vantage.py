"""Approximate nearest neighbours: vantage-point trees per shard.

Every valid vector is dealt to a shard by a hash of its id; each shard holds
one vantage-point tree, and every query is searched in every shard, block by
block. A subtree is skipped when ``factor`` times its triangle-inequality
bound exceeds the query's k-th distance so far: factor 1 is exact search,
larger factors skip more and may miss neighbours. The shards' answers are
merged by exact distance.

Copies: of equal vectors only the k + 1 smallest ids can be among anybody's k
nearest, so no more enter the index (the planner limits them before the
shuffle). Query rows are not reduced.

Leaves are scanned by one matrix product, which leaves out what is too far
whatever its rounding; the rest is scored by differences, so scores and ties
are exact.

Memory: one shard's tree (``shard_rows`` vectors) and one batch of queries per
task; queries stream past the tree.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; equal (id, vector) rows
count once; only vectors of a query's own length are its candidates; fewer
candidates than k give fewer rows; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.shared import Scratch, concat_batches, doc_columns

LEAF = 256
SHARD_ROWS = 32_768
MIN_SHARD_ROWS = 2_048   # smaller inputs are not cut further
_SLACK = 1e-9            # relative room for rounding in the pruning test
_ROUNDING = 8 * np.finfo(np.float64).eps  # per component, of a matrix product against differences


class VantageTree:
    """Median-split vantage-point tree over the rows of a float64 matrix."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.points, self.ids = points, ids
        self.nodes: list = []  # (vantage row, radius, inside node, outside node) or leaf rows
        todo = [(np.arange(len(points)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            if len(rows) <= LEAF:
                self.nodes.append(rows)
                continue
            pick = int(rng.integers(len(rows)))
            vantage, rest = rows[pick], np.delete(rows, pick)
            far = distances(points[vantage][None], points[rest])[0]
            order = np.argsort(far, kind="stable")
            half = len(rest) // 2
            radius = (far[order[half - 1]], far[order[half]])  # of the inside, of the outside
            self.nodes.append([vantage, radius, None, None])
            todo.append((rest[order[half:]], at, 3))
            todo.append((rest[order[:half]], at, 2))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest found per query, ascending, ties
        to the smaller id; infinite where there are fewer. ``own`` ids are
        never a query's answer."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(active, d, ids):
            """Merge distances d to the points ``ids`` (both a row per active
            query; infinite: none) into the answers."""
            d = np.where(ids == own[active][:, None], np.inf, d)
            use = (d <= best[active, -1:]).any(1)
            if not use.any():
                return
            active, d, ids = active[use], d[use], ids[use]
            all_d = np.concatenate([best[active], d], 1)
            all_i = np.concatenate([found[active], ids], 1)
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[active] = np.take_along_axis(all_d, order, 1)
            found[active] = np.take_along_axis(all_i, order, 1)

        def scan(active, rows):
            """Offer a leaf: one matrix product leaves out what cannot be among
            the k nearest, the rest is scored exactly."""
            kept = self.near(queries[active], own[active], rows, best[active, -1], k)
            width = kept.sum(1)
            use = np.flatnonzero(width)
            if not len(use):
                return
            q, p = np.nonzero(kept[use])
            slot = np.arange(len(q)) - np.repeat(np.cumsum(width[use]) - width[use], width[use])
            d = np.full((len(use), int(width.max())), np.inf)
            ids = np.full(d.shape, np.iinfo(np.int64).max)
            d[q, slot] = paired_distances(queries[active[use]], q, self.points[rows], p)
            ids[q, slot] = self.ids[rows][p]
            offer(active[use], d, ids)

        # nearer halves first: a stack of (node, queries, their lower bounds)
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, active, bound = stack.pop()
            live = bound * factor <= best[active, -1] * (1 + _SLACK) + _SLACK
            active = active[live]
            if not len(active):
                continue
            bound = bound[live]
            content = self.nodes[node]
            if isinstance(content, np.ndarray):
                if len(content):
                    scan(active, content)
                continue
            vantage, (inner, outer), inside, outside = content
            d = distances(queries[active], self.points[vantage][None])[:, 0]
            offer(active, d[:, None], np.full((len(active), 1), self.ids[vantage]))
            low_in = np.maximum(bound, d - inner)
            low_out = np.maximum(bound, outer - d)
            near_in = d * 2 <= inner + outer
            for chosen, first, second, b1, b2 in (
                    (near_in, inside, outside, low_in, low_out),
                    (~near_in, outside, inside, low_out, low_in)):
                if chosen.any():
                    stack.append((second, active[chosen], b2[chosen]))
                    stack.append((first, active[chosen], b1[chosen]))
        return best, found

    def near(self, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, reach: np.ndarray,
             k: int) -> np.ndarray:
        """Which (query, row) pairs may be among the query's k nearest: squared
        distances by a matrix product, with room for its rounding. ``reach`` is
        the k-th distance so far."""
        points = self.points[rows]
        with np.errstate(all="ignore"):
            norms = (queries ** 2).sum(1)[:, None] + (points ** 2).sum(1)[None]
            square = norms - 2 * (queries @ points.T)
            room = norms * (_ROUNDING * (queries.shape[1] + 8)) + np.finfo(np.float64).tiny
            low, high = square - room, square + room
            sure = np.isfinite(low) & np.isfinite(high)  # else: scored exactly
            other = self.ids[rows][None] != own[:, None]
            limit = reach ** 2 * (1 + _SLACK)
            if len(rows) > k:
                upper = np.where(sure & other, high, np.inf)
                limit = np.minimum(limit, np.partition(upper, k - 1, 1)[:, k - 1])
            return other & (~sure | (low <= limit[:, None]))


def paired_distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows a[i] to b[j], by differences."""
    out = np.empty(len(i))
    step = max(1, 2_000_000 // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        diff = a[i[at:at + step]] - b[j[at:at + step]]
        out[at:at + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, by differences
    (exact to rounding, also for near points)."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, a.shape[1] * len(b)))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int, factor: float):
    """Rows sorted by (shard, dim, is_query): a shard's vectors, then its queries."""
    def matrix(batch):
        flat = batch.column(4)
        return np.array(flat.values.to_numpy(zero_copy_only=False)[
            flat.offsets[0].as_py():flat.offsets[-1].as_py()], np.float64).reshape(batch.num_rows, -1)

    def rows(batches):
        current, ids, parts, tree = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                            for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, b.num_rows]):
                piece = b.slice(start, stop - start)
                shard, is_query = tuple(key[start][:2]), key[start][2]
                if shard != current:
                    current, ids, parts, tree = shard, [], [], None
                if not is_query:
                    ids.append(piece.column(3).to_numpy(zero_copy_only=False))
                    parts.append(matrix(piece))
                    continue
                if not parts:
                    continue
                if tree is None:
                    tree = VantageTree(np.concatenate(parts), np.concatenate(ids))
                own = piece.column(3).to_numpy(zero_copy_only=False)
                best, found = tree.search(matrix(piece), own, k, factor)
                hit = np.isfinite(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, hit.sum(1))), pa.array(found[hit]), pa.array(best[hit])],
                    schema=_FOUND)

    return lambda batches: concat_batches(rows(batches), _FOUND)


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (doc_columns(table, "vec_id", "embedding")
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("embedding").cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull())
            .where(finite & F.exists(v, lambda x: x != 0)))


def nearest(spark: SparkSession, table: DataFrame, queries, k: int = 10, factor: float = 1.0,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every query.

    ``queries`` is a condition (Column) on vec_id that picks the query rows;
    every other row is a candidate. ``factor`` >= 1 relaxes the pruning.
    """
    if factor < 1 or k < 1 or shard_rows < 1:
        raise ValueError("factor, k and shard_rows are 1 at least")
    scratch = Scratch(spark, "vantage")
    vectors = scratch.save(valid_vectors(table), "vectors")
    rows = vectors.count()
    shards = max(1, math.ceil(rows / shard_rows),
                 min(spark.sparkContext.defaultParallelism, rows // MIN_SHARD_ROWS))

    # of equal vectors the k + 1 smallest ids; repeated rows once
    smallest = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = (vectors.withColumn("copy", smallest).where(F.col("copy") <= k + 1)
            .dropDuplicates(["v", "vec_id"]))
    dim = F.size("v").alias("dim")
    index = kept.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), dim,
                        F.lit(0).alias("is_query"), "vec_id", "v")
    asked = (vectors.where(queries).dropDuplicates(["vec_id", "v"])
             .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dim,
                     F.lit(1).alias("is_query"), "vec_id", "v"))
    # by range: hashes of few shard numbers would put several into one task
    dealt = (index.union(asked).repartitionByRange(shards, "shard")
             .sortWithinPartitions("shard", "dim", "is_query"))
    found = dealt.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
