"""Hard negatives by L2AP-style threshold joins over integer inner products.

For every anchor: its best rows of the same label (positives), and for each
positive the best rows of other labels whose score lies in a window below the
positive's. Scores are exact integers.

Shards: a few pivot vectors (``PIVOTS`` smallest hashed ids) cut the rows into
cells by direction; a cell knows its greatest norm and its widest angle to the
pivot. Cells are packed into shards, large ones split by a hash of the id, so
neither a label nor a crowd of equal vectors fills one task. An anchor first
searches its own shard; what it finds there is a lower bound for the rest, and
only shards with a cell whose angle bound reaches it are searched as well.

Within a shard (``SuffixIndex``): components are ordered by energy; the posting
lists of a component hold the rows for which its suffix could still matter: the
suffix whose norm bound cannot reach the threshold is left out. Partial scores
are accumulated list by list, and a pair is dropped when its partial score plus
the product of the remaining norms is below the threshold. The left-out suffix
of the few survivors is added exactly. A threshold starts high and is lowered
until all windows of the anchor are full or its floor is reached, so every row
above the last threshold has been seen and results are exact.

Memory: one shard (``SHARD_ROWS`` rows) and one Arrow batch of anchors per task;
the driver holds one row per cell.

Defined results: rows with a null id, a null label, a null or empty vector or a
null or non-finite component take no part; of rows with one id the least (label,
vector) counts; only vectors of an anchor's own length are its partners; scaled
components are held within +-2**23; a negative positive score has an empty
window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.shared import Scratch, concat_batches, doc_columns

PIVOTS = 64
SHARD_ROWS = 32_768
MIN_SHARD_ROWS = 2_048  # smaller inputs are not cut further
LIMIT = 1 << 23
GROUP = 8               # components per step of the accumulation
LOWER = 0.8             # factor on a threshold that left a window open
STEPS = 8               # such factors before the floor itself
_TILE = 2_000_000       # pairs scored at a time
_LEAST = -(1 << 62)
_SLACK = 1e-9

_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])
_ROWS_DDL = "vec_id long, label long, dim int, v binary"
_WINDOWS_DDL = "array<struct<w:int,lo:bigint,hi:bigint>>"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()),
                    ("score", pa.int64())])
_FOUND_DDL = "anchor_id long, w int, vec_id long, score long"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of little-endian 32-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(-1, dim)


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


class SuffixIndex:
    """Posting lists over the integer rows of one shard."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x, self.ids, self.labels = x[:, self.order], ids, labels
        self.cuts = [*range(0, x.shape[1], GROUP), x.shape[1]]
        self.norms = self.suffix_norms(self.x)
        self.level, self.lists = None, []

    def suffix_norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of x[cut:] for every cut, the whole vector first."""
        squares = x.astype(np.float64) ** 2
        parts = np.stack([squares[:, a:b].sum(1) for a, b in zip(self.cuts, self.cuts[1:])], 1)
        back = np.cumsum(parts[:, ::-1], 1)[:, ::-1]
        return np.sqrt(np.concatenate([back, np.zeros((len(x), 1))], 1))

    def postings(self, threshold: float, most: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, components) per group of components for queries of norm up to
        ``most``; a row is not listed from the group on where its suffix's bound
        is below the threshold."""
        if self.level is None or threshold < self.level[0] or most > self.level[1] \
                or threshold > 1.5 * self.level[0] > 0:
            self.level, self.lists = (threshold, most), []
            for g, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
                rows = np.flatnonzero(self.norms[:, g] * most * (1 + _SLACK) + _SLACK >= threshold)
                self.lists.append((rows, np.ascontiguousarray(self.x[rows, a:b].T, self.kind)))
        return self.lists

    def exact_in_doubles(self, most: float) -> bool:
        return most * float(self.norms[:, 0].max(initial=0)) < 2.0 ** 52

    def above(self, q: np.ndarray, q_norms: np.ndarray, threshold: np.ndarray):
        """(query, row, exact score) of all pairs that reach their query's threshold."""
        most = float(q_norms[:, 0].max(initial=0))
        self.kind = np.float64 if self.exact_in_doubles(most) else np.int64
        lists = self.postings(float(threshold.min()), most)
        q = q.astype(self.kind)
        rows = lists[0][0]                    # rows listed nowhere cannot reach a threshold
        left = np.zeros(len(rows), np.int64)  # per row the first group whose part is missing
        scores = np.zeros((len(q), len(rows)), self.kind)
        alive = np.ones(scores.shape, bool)
        for g, (listed, components) in enumerate(lists):
            # suffix norms fall from group to group, so a list holds no row that an earlier one lacks
            keep = np.isin(listed, rows, assume_unique=True)
            at = np.searchsorted(rows, listed[keep])
            part = q[:, self.cuts[g]:self.cuts[g + 1]] @ components[:, keep]
            scores[:, at] += part
            left[at] = g + 1
            rest = q_norms[:, left] * self.norms[rows, left] * (1 + _SLACK) + _SLACK
            alive = scores + rest >= threshold[:, None]
            if alive.sum() * GROUP < alive.size:
                break
            some = alive.any(0)
            if some.sum() * 2 < len(rows):    # rows that no query needs leave
                rows, left, scores, alive = rows[some], left[some], scores[:, some], alive[:, some]
        qi, ri = np.nonzero(alive)
        out = scores[qi, ri].astype(np.int64)
        for h, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            pairs = np.flatnonzero(left[ri] <= h)
            for some in np.array_split(pairs, len(pairs) * GROUP // _TILE + 1):
                out[some] += np.einsum("ij,ij->i", q[qi[some], a:b],
                                       self.x[rows[ri[some]], a:b].astype(self.kind)).astype(np.int64)
        keep = out >= threshold[qi]
        return qi[keep], rows[ri[keep]], out[keep]

    def search(self, q: np.ndarray, own: np.ndarray, own_labels: np.ndarray, windows: list,
               k: int, same_label: bool):
        """Rows (query, window, row, score): per query and window (w, lo, hi) the
        ``k`` best partners with lo <= score <= hi, ties to the smaller id."""
        out = []
        if not len(self.x) or not len(q):
            return out
        step = max(1, _TILE // len(self.x))
        q = q[:, self.order]
        q_norms = self.suffix_norms(q)
        reach = q_norms[:, 0] * self.norms[:, 0].max()
        for start in range(0, len(q), step):
            todo = np.arange(start, min(start + step, len(q)))
            floor = {i: min(lo for _, lo, _ in windows[i]) for i in todo}
            begin = {i: max(floor[i], int(0.95 * min(min(hi for _, _, hi in windows[i]), 0.55 * reach[i])))
                     for i in todo}
            t = np.array([begin[i] for i in todo], np.int64)
            for attempt in range(STEPS + 1):
                if attempt == STEPS:
                    t = np.array([floor[i] for i in todo], np.int64)
                qi, ri, s = self.above(q[todo], q_norms[todo], t)
                fits = (self.ids[ri] != own[todo][qi]) & ((self.labels[ri] == own_labels[todo][qi]) == same_label)
                qi, ri, s = qi[fits], ri[fits], s[fits]
                order = np.lexsort((self.ids[ri], -s, qi))
                qi, ri, s = qi[order], ri[order], s[order]
                ends = np.searchsorted(qi, np.arange(len(todo) + 1))
                again = []
                for j, i in enumerate(todo):
                    mine = slice(ends[j], ends[j + 1])
                    score, row = s[mine], ri[mine]
                    # of the scores in falling order, where a window begins
                    tops = [np.searchsorted(-score, -hi) for _, _, hi in windows[i]]
                    got = [(w, row[a:a + k], score[a:a + k], lo)
                           for a, (w, lo, _) in zip(tops, windows[i])]
                    if t[j] > floor[i] and any(len(g[1]) < k for g in got):
                        again.append(j)
                        continue
                    for w, r, sc, lo in got:
                        out += [(i, w, int(x), int(y)) for x, y in zip(r, sc) if y >= lo]
                if not again:
                    break
                todo = todo[again]
                t = np.maximum(np.floor(t[again] * LOWER).astype(np.int64),
                               np.array([floor[i] for i in todo], np.int64))
        return out


def _search(k: int, same_label: bool):
    """Rows sorted by (shard, dim, asks): a shard's vectors, then its anchors."""
    def rows(batches):
        current, parts, index = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                            for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, b.num_rows]):
                piece = b.slice(start, stop - start)
                group, asks = tuple(key[start][:2]), key[start][2]
                if group != current:
                    current, parts, index = group, [], None
                own, labels = (piece.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                v = _vectors(piece.column(5), int(group[1]))
                if not asks:
                    parts.append((v, own, labels))
                    continue
                if not parts:
                    continue
                if index is None:
                    index = SuffixIndex(*(np.concatenate(c) for c in zip(*parts)))
                windows = [[(w["w"], w["lo"], w["hi"]) for w in ws] for ws in piece.column(6).to_pylist()]
                found = index.search(v, own, labels, windows, k, same_label)
                at, w, row, score = (np.array(c, np.int64) for c in (zip(*found) if found else [()] * 4))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array(w.astype(np.int32)), pa.array(index.ids[row]),
                     pa.array(score)], schema=_FOUND)
    return lambda batches: concat_batches(rows(batches), _FOUND)


def _scale(scale: int):
    def run(batches):
        for b in batches:
            vectors = []
            for v in b.column(2):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                vectors.append(np.clip(x, -LIMIT, LIMIT).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(v) // 4 for v in vectors], pa.int32()),
                 pa.array(vectors, pa.binary())], schema=_ROWS)
    return run


def _with_cells(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivot of a row's length by angle (-1: none), the cosine
    to it and the row's norm."""
    schema = pa.schema([*_ROWS, ("cell", pa.int32()), ("near", pa.float64()), ("norm", pa.float64())])

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy(zero_copy_only=False)
            cell, near, norm = np.full(len(dims), -1, np.int32), np.full(len(dims), -1.0), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit, norm[at] = _directions(_vectors(b.column(3).take(pa.array(at)), dim))
                if dim in pivots:
                    cosine = unit @ pivots[dim].T
                    cell[at], near[at] = cosine.argmax(1), cosine.max(1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(cell), pa.array(near), pa.array(norm)], schema=schema)
    return run


def _pack_cells(cells: list, target: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(dim, cell) -> (first shard, shards): small cells share one, large ones
    have several."""
    plan, shard, room = {}, -1, 0
    for c in sorted(cells, key=lambda c: (c.dim, c.cell)):
        if c.n > target:
            plan[c.dim, c.cell] = (shard + 1, math.ceil(c.n / target))
            shard, room = shard + math.ceil(c.n / target), 0
            continue
        if c.n > room:
            shard, room = shard + 1, target
        plan[c.dim, c.cell] = (shard, 1)
        room -= c.n
    return plan


def _route(plan, cells: list, pivots: dict[int, np.ndarray]):
    """Anchors to the shards, other than their own, that a cell's bound admits."""
    per_dim: dict[int, list] = {}
    for c in cells:
        per_dim.setdefault(c.dim, []).append(c)

    def run(batches):
        for b in batches:
            names = b.schema.names
            dims, home = (b.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("dim", "shard"))
            v, windows = b.column(names.index("v")), b.column(names.index("windows")).to_pylist()
            rows, shards = [], []
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit, norm = _directions(_vectors(v.take(pa.array(at)), dim))
                mine = per_dim.get(dim, [])
                spread = np.array([np.arccos(np.clip(c.near, -1, 1)) if c.cell >= 0 else np.pi for c in mine])
                away = np.zeros((len(at), len(mine)))
                for j, c in enumerate(mine):
                    if c.cell >= 0:
                        away[:, j] = np.arccos(np.clip(unit @ pivots[dim][c.cell], -1, 1))
                bound = np.cos(np.maximum(0, away - spread - 1e-6)) * norm[:, None] * [c.norm for c in mine]
                for i, row in enumerate(at.tolist()):
                    least = min(w["lo"] for w in windows[row])
                    admitted = {s for j, c in enumerate(mine) if bound[i, j] * (1 + _SLACK) + 1e-3 >= least
                                for first, n in [plan[dim, c.cell]] for s in range(first, first + n)}
                    admitted.discard(int(home[row]))
                    rows += [row] * len(admitted)
                    shards += sorted(admitted)
            out = b.take(pa.array(rows, pa.int64()))
            yield out.set_column(names.index("shard"), "shard", pa.array(shards, pa.int32()))
    return run


def usable(table: DataFrame, label) -> DataFrame:
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (doc_columns(table, "vec_id", "label", "embedding")
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.col("embedding").cast("array<double>").alias("v"))
            .where("vec_id is not null and label is not null and v is not null").where(F.size("v") > 0)
            .where(whole))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(spark: SparkSession, table: DataFrame, anchors, label=None, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition (Column) on vec_id, ``label`` a column expression
    over vec_id and label. A negative of a positive with score p has
    low * p <= 100 * score <= high * p.
    """
    if not 0 <= low <= high or positives < 1 or negatives < 1 or shard_rows < 1:
        raise ValueError("0 <= low <= high; positives, negatives and shard_rows are 1 at least")
    scratch = Scratch(spark, "negatives")
    rows = usable(table, F.col("label") if label is None else label).mapInArrow(_scale(scale), _ROWS_DDL)
    rows = scratch.save(rows, "scaled")
    total = rows.count()
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("s")).select("vec_id", "s.*")

    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = {dim: _directions(np.stack([np.frombuffer(r.v, "<i4") for r in picked if r.dim == dim]))[0]
              for dim in {r.dim for r in picked}}
    rows = scratch.save(rows.mapInArrow(_with_cells(pivots), _ROWS_DDL + ", cell int, near double, norm double"),
                        "rows")
    scratch.drop("scaled")
    cells = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"),
                                            F.min("near").alias("near")).collect()
    target = min(shard_rows, max(MIN_SHARD_ROWS, math.ceil(total / spark.sparkContext.defaultParallelism)))
    plan = _pack_cells(cells, target)
    shards = max((first + n for first, n in plan.values()), default=1)
    places = spark.createDataFrame([(d, c, first, n) for (d, c), (first, n) in plan.items()],
                                   "dim int, cell int, first int, parts int")  # one row per cell
    dealt = (rows.join(F.broadcast(places), ["dim", "cell"])
             .select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"),
                     "dim", F.lit(0).alias("asks"), "vec_id", "label", "v"))
    asked = dealt.where(anchors).withColumn("asks", F.lit(1))

    def search(asks: DataFrame, k: int, same: bool) -> DataFrame:
        both = dealt.withColumn("windows", F.lit(None).cast(_WINDOWS_DDL)).union(
            asks.select("shard", "dim", "asks", "vec_id", "label", "v", "windows"))
        return (both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "asks")
                .mapInArrow(_search(k, same), _FOUND_DDL))

    def everywhere(asks: DataFrame, k: int, same: bool, tag: str) -> DataFrame:
        """The best of the own shard, then of all that can still hold better ones."""
        asks = scratch.save(asks, f"{tag}-asks")
        home = scratch.save(_best(search(asks, k, same), k), f"{tag}-home")
        if shards == 1:
            return home
        floors = (home.groupBy(F.col("anchor_id").alias("vec_id"), "w")
                  .agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")))
        raised = (asks.select("vec_id", F.explode("windows").alias("x")).select("vec_id", "x.*")
                  .join(floors, ["vec_id", "w"], "left")
                  .groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct(
                      "w", F.greatest("lo", "floor").alias("lo"), "hi"))).alias("windows")))
        routed = (asks.drop("windows").join(raised, "vec_id")
                  .select("shard", "dim", "asks", "vec_id", "label", "v", "windows"))
        rest = search(routed.mapInArrow(_route(plan, cells, pivots), routed.schema), k, same)
        return scratch.save(_best(home.drop("rank").union(rest), k), f"{tag}-all")

    open_window = F.array(F.struct(F.lit(0).alias("w"), F.lit(_LEAST).alias("lo"), F.lit(-_LEAST).alias("hi")))
    first = everywhere(asked.withColumn("windows", open_window), positives, True, "positives")
    pairs = first.where("score >= 0").select(
        "anchor_id", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"))
    lo = F.expr(f"({low} * positive_score + 99) div 100")
    hi = F.expr(f"({high} * positive_score) div 100")
    windows = (pairs.where(lo <= hi).groupBy(F.col("anchor_id").alias("vec_id"))
               .agg(F.array_sort(F.collect_list(F.struct("w", lo.alias("lo"), hi.alias("hi")))).alias("windows")))
    second = everywhere(asked.join(windows, "vec_id"), negatives, False, "negatives")
    return (second.select("anchor_id", "w", "rank", F.col("vec_id").alias("negative_id"),
                          F.col("score").alias("negative_score"))
            .join(pairs, ["anchor_id", "w"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


HARD_NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
k AS MATERIALIZED (SELECT vec_id, m.label AS label, m.v AS v
  FROM (SELECT vec_id, min({'label': label, 'v': v}) AS m FROM r GROUP BY vec_id)),
p AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
  FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
f AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT f.anchor_id, positive_id,
  row_number() OVER (PARTITION BY f.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM f JOIN p ON p.anchor_id = f.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
