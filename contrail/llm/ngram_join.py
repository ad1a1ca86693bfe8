"""N-gram Jaccard join over word shingles with count-vector R-trees.

Each document is the set of its distinct word shingles; two documents link
when ``den * |A & B| >= num * |A | B|``. The result is exact:

1. Equal sets collapse to one class first, whatever their number.
2. Shards. For two linked sets the symmetric difference is at most
   K = (den - num) / (num + den) * (|A| + |B|). The hash space is cut into
   K + 1 + s ranges, so at least s + 1 ranges hold the same shingles in both
   sets. Each class enters one shard per range (key: size level, range, digest
   of the range's shingles); linked classes share a shard. Weak ranges, empty
   or of common shingles only, are left out by sets with s of them at most,
   which still share another one. So shared boilerplate makes no shard: a whole
   range must agree and hold a shingle that is not common. Which shingles are
   common (``COMMON`` of a task's texts; of these the ``COMMON_KEPT`` most
   frequent over all tasks, 8 MB) changes only the work, never the result.
3. R-trees. Tokens are hashed into ``GROUPS`` groups, a class is the point of
   its group counts, and the sum of coordinate minima against a node's upper
   corner (or a point) bounds the overlap. All candidate pairs come from such
   trees, bulk-loaded with ``BLOCK`` points or about; the survivors are
   verified on the full sets.
   a. Pivot rounds: every class enters the tree of one pivot class, the one it
      shares most shards with, and the pivot searches its trees. Later rounds
      draw new pivots from a shard's largest component and only enter classes
      of other components. Large groups of near copies join here with one
      point per member and round, so no shard emits all its pairs.
   b. Open shards: what is left are shards with several components; of those
      with the same classes one stays. In a shard of ``BLOCK`` classes at most
      those outside its largest component are loaded into a tree and all
      search it; classes that the candidate pairs connect form a group.
      Larger shards are contracted to their components; components that share
      such shards, directly or through others, form a cluster.
   c. Groups that share classes, directly or through others, are searched as
      one if they fit one tree, as a cluster if that sends fewer sets than the
      groups or if one fits no tree, and by themselves else.
   d. In a group, the classes outside its largest component are loaded into a
      tree and all search it; in a cluster, these classes are loaded into trees
      by size level and hash, and its classes of fitting size search them. Here
      the sets go with the classes: candidates are verified where they are
      found, and a task returns only links that join two components. So no
      task returns more rows than it reads, however many pairs it compares.
4. Components of the verified links.

A task holds one block of sets and one batch of the stream. Classes are identified by a 64-bit digest of their set
and shingles by 64-bit hashes.

Defined results: null or empty text has no shingles and links with nothing;
rows with null ``doc_id`` keep their ``n_shingles`` and get a null component
unless their set equals that of a row with an id; repeated rows count as
copies; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from contrail.llm.components import components
from contrail.llm.shared import Scratch, binary_values, concat_batches, doc_columns, mix, runs, tidy
from contrail.llm.words import shingle_set

GROUPS = 128         # coordinates of a count vector
FANOUT = 16          # entries per R-tree node
BLOCK = 1024         # classes in one tree
SHINGLES = 2_000_000  # shingles of the sets in one tree (16 MB)
STREAM = 16_384      # classes that stream past one tree in one task
SMALL_IDS = 1_000_000  # candidate ids that may be broadcast (8 bytes each)
STAR_ROUNDS = 3      # most pivot rounds
COMMON = 0.005       # share of a task's texts that makes a shingle common
COMMON_KEPT = 1_000_000  # common shingles that are sent to the tasks (8 bytes each)
COUNTERS = 150_000   # common candidates a task counts at a time
_SEEN = 200_000      # set digests a worker remembers to skip repeated copies


NONE = np.empty(0, np.uint64)


# ---- size levels ----------------------------------------------------------

@lru_cache(maxsize=8)
def size_levels(num: int, den: int, top: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """First size of each level, and the largest symmetric difference of a
    linked pair whose smaller set is on that level."""
    lows, bounds, low = [], [], 1
    while low <= top:
        high = max(low, den * low // num)
        partner = den * high // num
        lows.append(low)
        bounds.append((high + partner) * (den - num) // (num + den))
        low = high + 1
    return np.array(lows), np.array(bounds)


@lru_cache(maxsize=4096)
def spare_ranges(low: int, bound: int) -> int:
    """Ranges cut beyond the K + 1 needed: about as many as stay weak in a set
    of the level's smallest size, and room for chance."""
    spare = 1
    while spare <= bound:
        parts = bound + 1 + spare
        weak = parts * min(1.0, 1.3 * math.exp(-low / parts) + 0.01)
        if spare >= weak + 3 * math.sqrt(weak):
            break
        spare += 1
    return spare


def among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


def shard_keys(s: np.ndarray, num: int, den: int, common: np.ndarray = NONE) -> np.ndarray:
    """Keys of the shards a set (sorted hashes) belongs to."""
    lows, bounds = size_levels(num, den)
    own = int(np.searchsorted(lows, len(s), side="right")) - 1
    rare = np.concatenate(([0], np.cumsum(~among(s, common))))
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s + np.uint64(1)), out=sums[1:])
    out = []
    for level in (own, own - 1):
        if level < 0 or bounds[level] == 0:  # only equal sets could link
            continue
        spare = spare_ranges(int(lows[level]), int(bounds[level]))
        parts = int(bounds[level]) + 1 + spare
        width = (1 << 64) // parts + 1
        edges = np.array([i * width for i in range(1, parts)], np.uint64)
        at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
        label = mix(np.uint64(level << 32) + np.arange(parts, dtype=np.uint64) + np.uint64(1))
        keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ label)
        strong = rare[at[1:]] > rare[at[:-1]]
        out.append(keys if (~strong).sum() > spare else keys[strong])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def set_digest(s: np.ndarray) -> int:
    return int(np.uint64(xxh3_64_intdigest(s.tobytes())).astype(np.int64))


# ---- R-tree on count vectors ----------------------------------------------

def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


class CountRTree:
    """Static R-tree over count vectors, packed by size and then position."""

    def __init__(self, points: np.ndarray):
        self.points = points
        total = points.sum(1)
        order = np.lexsort((points[:, 1], points[:, 0], total)) if len(points) else np.empty(0, int)
        self.order = order
        high, lows = points[order], total[order]
        self.levels = [(high, lows)]  # upper corners and smallest sizes; level 0: the points
        while len(high) > FANOUT:
            cut = np.arange(0, len(high), FANOUT)
            high, lows = np.maximum.reduceat(high, cut), np.minimum.reduceat(lows, cut)
            self.levels.append((high, lows))

    def candidates(self, query: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, point index) whose summed coordinate minima
        reach the overlap that a link needs."""
        size = query.sum(1)
        top_high, _ = self.levels[-1]
        q = np.repeat(np.arange(len(query)), len(top_high))
        node = np.tile(np.arange(len(top_high)), len(query))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, lows = self.levels[depth]
            keep = np.empty(len(q), bool)
            for i in range(0, len(q), 8192):
                qi, ni = q[i:i + 8192], node[i:i + 8192]
                shared = np.minimum(query[qi], high[ni]).sum(1)
                keep[i:i + 8192] = shared * (num + den) >= num * (size[qi] + lows[ni])
            q, node = q[keep], node[keep]
            if depth:
                width = len(self.levels[depth - 1][0])
                child = node[:, None] * FANOUT + np.arange(FANOUT)
                q = np.repeat(q, FANOUT)
                node = child.ravel()
                real = node < width
                q, node = q[real], node[real]
        return q, self.order[node]


# ---- tasks -----------------------------------------------------------------

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])


def _describe(k: int):
    def task(batches):
        for b in batches:
            ids = b.column(0).cast(pa.int64())
            n, cls = [], []
            for data in binary_values(b.column(1)):
                s = shingle_set(data, k)
                n.append(len(s))
                cls.append(set_digest(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cls, pa.int64())],
                                             schema=_SETS)
    return task


def _common(k: int):
    """Shingles in a share of COMMON of the partition's texts. A batch counts
    only the shingles it holds twice, so a common one may be counted low."""
    def task(batches):
        counts: dict[int, int] = {}
        texts = 0
        for b in batches:
            sets = [shingle_set(x, k) for x in binary_values(b.column(0))]
            texts += len(sets)
            value, n = np.unique(np.concatenate([NONE, *sets]), return_counts=True)
            for v, c in zip(value[n > 1].view(np.int64).tolist(), n[n > 1].tolist()):
                counts[v] = counts.get(v, 0) + c
            if len(counts) > COUNTERS:
                floor = max(2, COMMON * texts / 2)
                counts = {v: c for v, c in counts.items() if c > floor}
        found = {v: c for v, c in counts.items() if c >= max(8, COMMON * texts)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()),
                                          pa.array(list(found.values()), pa.int64())], names=["shingle", "n"])
    return task


_KEYS = pa.schema([("sig", pa.int64()), ("cls", pa.int64())])


def _shards(k: int, num: int, den: int, common: np.ndarray):
    def rows(batches):
        seen: set[int] = set()
        for b in batches:
            keys, owners = [], []
            for data in binary_values(b.column(0)):
                s = shingle_set(data, k)
                if not len(s):
                    continue
                c = set_digest(s)
                if c in seen:  # an exact copy of a set this worker has dealt out
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(c)
                x = shard_keys(s, num, den, common)
                keys.append(x)
                owners.append(np.full(len(x), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))],
                    schema=_KEYS)

    return lambda batches: concat_batches(rows(batches), _KEYS)


_CAND = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])


def _sets(k: int):
    def task(batches):
        for b in batches:
            found = [shingle_set(x, k) for x in binary_values(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_digest(s) for s in found], pa.int64()),
                 pa.array([s.tobytes() for s in found], pa.binary())], schema=_CAND)
    return task


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return den * shared >= num * (len(a) + len(b) - shared)


def _verify(num: int, den: int):
    """Rows (a, b, shingles) sorted by (a, b); the row with b null holds a's set."""
    def task(batches):
        centre, base = None, None
        for t in batches:
            out_a, out_b = [], []
            for a, b, data in zip(t.column(0).to_pylist(), t.column(1).to_pylist(),
                                  t.column(2).to_pylist()):
                s = np.frombuffer(data, np.uint64)
                if b is None:
                    centre, base = a, s
                elif a == centre and _linked(base, s, num, den):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                             schema=_LINKS)
    return task


def _pack(counts: np.ndarray) -> bytes:
    return counts.astype("<u2" if counts.max(initial=0) < 65536 else "<u4").tobytes()


def _unpack(vectors: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<u2" if len(v) == 2 * GROUPS else "<u4") for v in vectors]).astype(np.int64)


def _vectors(batches):
    for b in batches:
        found = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in found], pa.int64()),
             pa.array([_pack(count_vector(s)) for s in found], pa.binary())], names=["cls", "n", "vec"])


def _tree_pairs(num: int, den: int):
    """Rows (cluster, block, salt, streamed, cls, comp, vec) in that order: the
    classes of a tree, then the stream. Pairs (streamed class, class of the
    tree) of different components."""
    def rows(batches):
        current, cls, comp, vectors, tree = None, [], [], [], None
        for t in batches:
            keys = list(zip(*[t.column(i).to_pylist() for i in range(4)]))
            ids, comps, vecs = (t.column(i).to_pylist() for i in (4, 5, 6))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at][:3] != current:
                    current, cls, comp, vectors, tree = keys[at][:3], [], [], [], None
                if not keys[at][3]:
                    cls += ids[at:end]
                    comp += comps[at:end]
                    vectors += vecs[at:end]
                elif cls:
                    if tree is None:
                        tree = CountRTree(_unpack(vectors))
                        own, side = np.array(cls, np.int64), np.array(comp, np.int64)
                    q, p = tree.candidates(_unpack(vecs[at:end]), num, den)
                    other = np.array(comps[at:end], np.int64)[q] != side[p]
                    a, b = np.array(ids[at:end], np.int64)[q[other]], own[p[other]]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINKS)
                at = end

    return lambda batches: concat_batches(rows(batches), _LINKS)


class Parts:
    """The part of each class of a tree; parts are joined by links."""

    def __init__(self, part: np.ndarray):
        self.of = part.copy()
        self._moved: dict[int, int] = {}

    def now(self, part: int) -> int:
        """The part that ``part`` has become."""
        seen = []
        while part in self._moved:
            seen.append(part)
            part = self._moved[part]
        self._moved.update(dict.fromkeys(seen, part))
        return part

    def join(self, part: int, to: np.ndarray) -> np.ndarray:
        """Joins a part with those of the classes ``to``: of each other part one of these."""
        parts, first = np.unique(self.of[to], return_index=True)
        new = parts != part
        if new.any():
            self.of[np.isin(self.of, parts[new])] = part
            self._moved.update(dict.fromkeys(parts[new].tolist(), part))
        return to[first[new]]


class Postings:
    """The sets of a tree by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles = np.concatenate([NONE, *sets])
        order = np.argsort(shingles, kind="stable")
        self._owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self._shingles, first = np.unique(shingles[order], return_index=True)
        self._at = np.append(first, len(shingles))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Shingles that each set shares with ``s`` (sorted)."""
        near = np.searchsorted(self._shingles, s)
        near = near[near < len(self._shingles)]
        near = near[self._shingles[near] == s[:len(near)]]
        start, n = self._at[near], self._at[near + 1] - self._at[near]
        each = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self._owner[each], minlength=len(self.sizes))


def _by_query(q: np.ndarray, p: np.ndarray):
    """(query, its points) of pairs in order of the query."""
    cuts = np.flatnonzero(np.diff(q)) + 1
    return zip(q[np.concatenate(([0], cuts))].tolist(), np.split(p, cuts)) if len(q) else ()


def _outside_largest(comp: np.ndarray) -> np.ndarray:
    value, n = np.unique(comp, return_counts=True)
    return np.flatnonzero(comp != value[n.argmax()])


_GROUPS = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64())])


def _shard_groups(num: int, den: int):
    """Rows (sig, cls, comp, vec) sorted by sig -> (sig of the group, cls, comp):
    a shard's classes that have a candidate of another component in the tree
    of those outside its largest one, or are one; such pairs share a group."""
    def rows(batches):
        for t in runs(batches, ["sig"]):
            cls, comp = (t.column(c).to_numpy() for c in ("cls", "comp"))
            held = _outside_largest(comp)
            if not len(held):
                continue
            points = _unpack(t.column("vec").to_pylist())
            q, p = CountRTree(points[held]).candidates(points, num, den)
            other = comp[q] != comp[held[p]]
            q, p = q[other], p[other]
            parts = Parts(held)
            for i, found in _by_query(q, p):
                parts.join(parts.now(i), found)
            met = np.unique(np.concatenate((q, held[p])))
            part = np.array([parts.now(i) for i in met.tolist()], np.int64)
            sig = mix(mix(cls[part].view(np.uint64)) ^ np.uint64(t.column("sig")[0].as_py() % (1 << 64)))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls[met]), pa.array(comp[met])],
                                             schema=_GROUPS)

    return lambda batches: concat_batches(rows(batches), _GROUPS)


class SetTree:
    """A tree of classes with their sets, searched by classes with theirs."""

    def __init__(self, cls: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], num: int, den: int):
        self._cls, self._parts, self._num, self._den = cls, Parts(comp), num, den
        self._sets = Postings(sets)
        self._tree = CountRTree(np.stack([count_vector(s) for s in sets]))

    def links(self, cls: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        """(searching class, class of the tree) of links that join two components."""
        out_a, out_b = [], []
        points = np.stack([count_vector(s) for s in sets])
        for i, found in _by_query(*self._tree.candidates(points, self._num, self._den)):
            part = self._parts.now(int(comp[i]))
            found = found[self._parts.of[found] != part]
            if not len(found):
                continue
            shared = self._sets.overlaps(sets[i])[found]
            union = len(sets[i]) + self._sets.sizes[found] - shared
            joined = self._parts.join(part, found[self._den * shared >= self._num * union])
            out_a += [cls[i]] * len(joined)
            out_b += self._cls[joined].tolist()
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], schema=_LINKS)


def _columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (t.column("cls").to_numpy(), t.column("comp").to_numpy(),
            [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()])


def _group_links(num: int, den: int):
    """Rows (sig, cls, comp, shingles) sorted by sig -> links of each group."""
    def rows(batches):
        for t in runs(batches, ["sig"]):
            cls, comp, sets = _columns(t)
            held = _outside_largest(comp)
            if len(held):
                yield SetTree(cls[held], comp[held], [sets[i] for i in held], num, den).links(cls, comp, sets)

    return lambda batches: concat_batches(rows(batches), _LINKS)


def _tree_links(num: int, den: int):
    """Rows (cluster, block, salt, streamed, cls, comp, shingles) in that order:
    the classes of a tree, then the stream -> links."""
    def rows(batches):
        current, held, tree = None, [], None
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(4)]))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at][:3] != current:
                    current, held, tree = keys[at][:3], [], None
                part = b.slice(at, end - at)
                if not keys[at][3]:
                    held.append(part)
                elif held or tree:
                    if tree is None:
                        tree, held = SetTree(*_columns(pa.Table.from_batches(held)), num, den), []
                    yield tree.links(*_columns(part))
                at = end

    return lambda batches: concat_batches(rows(batches), _LINKS)


_TREE = ["cluster", "block", "salt"]


def _searched(held: DataFrame, passing: DataFrame, points: DataFrame, task) -> DataFrame:
    """Pairs (a, b) that the trees of ``held`` give to the classes of ``passing``;
    both have columns cluster, block, salt, cls, comp. ``points``: (cls, what
    the task needs of it)."""
    cols = [*_TREE, "streamed", "cls", "comp"]
    both = (held.withColumn("streamed", F.lit(0)).select(*cols)
            .unionByName(passing.withColumn("streamed", F.lit(1)).select(*cols)))
    return (both.join(points, "cls").select(*cols, points.columns[1])
            .repartition(*_TREE).sortWithinPartitions(*_TREE, "streamed")
            .mapInArrow(tidy(task), "a long, b long"))


def _dealt(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """``rows`` with a number ``block`` that cuts the classes of each key into
    blocks of about BLOCK, or of about SHINGLES by the sum of ``weight`` if that
    is less, by a hash of the class."""
    full = F.count(F.lit(1)) / BLOCK
    if weight:
        full = F.greatest(full, F.sum(weight) / SHINGLES)
    blocks = rows.groupBy(*keys).agg(F.ceil(full).alias("blocks"))
    return rows.join(blocks, [*keys]).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")


def _pivot_round(tried: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (pivot a, class b) of ``tried`` that the pivots' trees leave."""
    held = _dealt(tried.select(F.col("a").alias("cluster"), F.col("b").alias("cls"), F.col("b").alias("comp"),
                               F.lit(0).alias("salt")), "cluster")
    passing = (held.select(*_TREE).distinct()
               .select(*_TREE, F.col("cluster").alias("cls"), F.col("cluster").alias("comp")))
    return _searched(held, passing, vectors.select("cls", "vec"), _tree_pairs(num, den))


def _one_of_equal(members: DataFrame) -> DataFrame:
    """``members`` of one of all shards (sig) that have the same classes, with
    their number (width)."""
    alike = members.groupBy("sig").agg(F.count(F.lit(1)).alias("width"), F.bit_xor(F.xxhash64("cls")).alias("x"),
                                       F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    return members.join(alike.groupBy("width", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "width"), "sig")


def _small_round(opened: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    """The groups (sig, cls, comp) of shards whose classes (sig, cls, comp) fit one tree."""
    return (opened.join(vectors.select("cls", "vec"), "cls").select("sig", "cls", "comp", "vec")
            .repartition("sig").sortWithinPartitions("sig")
            .mapInArrow(tidy(_shard_groups(num, den)), "sig long, cls long, comp long"))


def _verified_groups(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the components of each group (sig, cls, comp)."""
    return (groups.join(sets, "cls").select("sig", "cls", "comp", "shingles")
            .repartition("sig").sortWithinPartitions("sig")
            .mapInArrow(tidy(_group_links(num, den)), "a long, b long"))


def _merged_groups(groups: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of a written table of groups (sig, cls, comp, n) the groups (sig, cls,
    comp) that are searched by themselves or as one, and the classes (cls,
    comp, cluster) of those searched as clusters."""
    each = groups.groupBy("sig").agg(F.min("cls").alias("first"), F.sum("n").alias("weight"))
    linked = scratch.save(groups.join(each, "sig"), "linked")
    label = components(linked.select(F.col("cls").alias("a"), F.col("first").alias("b")), scratch, "groups")
    placed = linked.join(label.select(F.col("node").alias("cls"), F.col("label").alias("cluster")), "cls")
    members = placed.groupBy("cluster", "cls", "comp", "n").agg(F.count(F.lit(1)).alias("sent"),
                                                                F.max("weight").alias("weight"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES))
    fewer = (F.count(F.lit(1)) * (blocks + 1) <= F.sum("sent")) | (F.max("weight") > SHINGLES)
    way = scratch.save(members.groupBy("cluster").agg(
        F.when(blocks == 1, "one").when(fewer, "cluster").otherwise("each").alias("way")), "ways")
    members = members.join(way, "cluster")
    return (members.where("way = 'one'").select(F.col("cluster").alias("sig"), "cls", "comp").union(
                placed.join(way, "cluster").where("way = 'each'").select("sig", "cls", "comp")),
            members.where("way = 'cluster'").select("cls", "comp", F.xxhash64("cluster").alias("cluster")))


def _open_round(opened: DataFrame, vectors: DataFrame, sets: DataFrame, scratch: Scratch, num: int,
                den: int) -> DataFrame:
    """Links (a, b) that join the components of each cluster.

    ``opened`` has their classes (cls, comp, cluster).
    """
    level = F.floor(F.log("n") / math.log(den / num)) if num < den else F.col("n")
    placed = scratch.save(opened.join(vectors.select("cls", "n"), "cls")
                          .select("cls", "comp", "cluster", "n", level.cast("int").alias("level")), "placed")
    largest = (placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("size"))
               .groupBy("cluster").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"),
                                       F.sum("size").alias("total"))
               .select("cluster", "main", F.ceil(F.col("total") / STREAM).cast("int").alias("salts")))
    stray = scratch.save(_dealt(placed.join(largest, "cluster").where("comp <> main"), "cluster", "level",
                                weight="n")
                         .withColumn("block", F.struct("level", "block")), "stray")
    blocks = stray.groupBy("cluster", "block", "salts").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    held = stray.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    passing = (placed.join(blocks, "cluster")
               .where((F.col("n") * den >= F.col("lo") * num) & (F.col("n") * num <= F.col("hi") * den))
               .withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")))
    return _searched(held.withColumn("block", F.xxhash64("block")), passing.withColumn("block", F.xxhash64("block")),
                     sets, _tree_links(num, den))


# ---- the operator -----------------------------------------------------------

def _checked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of a written table that link. Each centre's set is sent
    once, its partners' sets stream past it; a hot centre is dealt over salts."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)))
    starts = salted.select("a", "salt").distinct()
    if pairs.count() <= SMALL_IDS:
        salted, starts = F.broadcast(salted), F.broadcast(starts)
    partners = sets.join(salted, F.col("b") == F.col("cls")).select("a", "salt", "b", "shingles")
    centres = (sets.join(starts, F.col("a") == F.col("cls"))
               .select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles"))
    dealt = (partners.unionByName(centres).repartition("a", "salt")
             .sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
             .select("a", "b", "shingles"))
    return dealt.mapInArrow(tidy(_verify(num, den)), "a long, b long")


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80,
                       den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when den * intersection >= num * union of their k-word
    shingle sets; component_id is the smallest doc_id reachable by links.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity num / den must be in (0, 1]")
    scratch = Scratch(spark, "jaccard")
    texts = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"),
                                                       "text")
    rows = scratch.save(texts.mapInArrow(tidy(_describe(k)), "doc_id long, n_shingles long, cls long"), "rows")
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))

    common = (texts.select("text").mapInArrow(tidy(_common(k)), "shingle long, n long")
              .groupBy("shingle").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "shingle").limit(COMMON_KEPT).select("shingle").collect())
    common = np.sort(np.array([r.shingle for r in common], np.int64).view(np.uint64))

    # shards, and each class's link to try with the shard's smallest class
    keys = texts.select("text").mapInArrow(tidy(_shards(k, num, den, common)), "sig long, cls long")
    first = F.first("cls").over(Window.partitionBy("sig").orderBy("cls"))
    shared = scratch.save(keys.withColumn("centre", first).where("centre <> cls"), "shared")
    scratch.release()

    # sets of the classes that share a shard with another
    wanted = shared.select("cls").union(shared.select(F.col("centre").alias("cls"))).distinct()
    ids = scratch.save(classes.join(wanted, "cls").where("rep IS NOT NULL")
                       .select(F.col("rep").alias("doc_id"), F.col("cls").alias("want")), "ids")
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    sets = scratch.save(texts.join(ids, "doc_id").select("text").mapInArrow(
        tidy(_sets(k)), "cls long, shingles binary").dropDuplicates(["cls"]), "sets")

    vectors = scratch.save(sets.mapInArrow(tidy(_vectors), "cls long, n long, vec binary"), "vectors")

    # pivot rounds
    stars = shared.select("cls", F.col("centre").alias("pivot"))
    members = shared.select("sig", "cls").union(shared.select("sig", F.col("centre").alias("cls"))).distinct()
    links = None
    for turn in range(STAR_ROUNDS):
        met = stars.groupBy("cls", "pivot").agg(F.count(F.lit(1)).alias("n"))
        tried = met.groupBy(F.col("cls").alias("b")).agg(
            F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("a"))
        tried = scratch.save(_pivot_round(tried, vectors, num, den), f"tried-{turn}")
        found = scratch.save(_checked(tried, sets, num, den), f"star-links-{turn}")
        scratch.drop(f"tried-{turn}")
        links = found if links is None else links.union(found)
        if turn and not found.limit(1).count():
            break
        label = components(links, scratch, f"star-{turn}")
        sizes = label.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        # what is open: shards whose classes are in different components
        placed = (members.join(label.join(sizes, "label"), F.col("cls") == F.col("node"), "left")
                  .select("sig", "cls", F.coalesce("label", "cls").alias("comp"),
                          F.coalesce("size", F.lit(1)).alias("size")))
        split = (placed.groupBy("sig").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.max_by(F.struct("cls", "comp"), F.struct("size", F.xxhash64("cls", F.lit(turn))))
            .alias("pivot"))
            .where("lo <> hi").select("sig", "pivot"))
        open_members = scratch.save(placed.join(split, "sig"), f"open-{turn}")
        scratch.drop("shared" if not turn else f"open-{turn - 1}")
        scratch.release()
        members = open_members.select("sig", "cls")
        stars = open_members.where("comp <> pivot.comp").select("cls", F.col("pivot.cls").alias("pivot"))

    # open shards: small ones each in a tree, large ones contracted to components
    shards = scratch.save(_one_of_equal(open_members), "shards")
    scratch.drop(f"open-{turn}")
    groups = scratch.save(_small_round(shards.where(F.col("width") <= BLOCK), vectors, num, den), "all-groups")
    groups = scratch.save(_one_of_equal(groups).join(vectors.select("cls", "n"), "cls")
                          .select("sig", "cls", "comp", "n"), "groups")
    groups, joined = _merged_groups(groups, scratch)
    large = shards.where(F.col("width") > BLOCK)
    cluster = components(large.where("comp <> pivot.comp").select(
        F.col("comp").alias("a"), F.col("pivot.comp").alias("b")).distinct(), scratch, "cluster")
    opened = large.select("cls", "comp").distinct().join(
        cluster.select(F.col("node").alias("comp"), F.col("label").alias("cluster")), "comp")
    opened = opened.select("cls", "comp", "cluster").union(joined)
    scratch.release()
    more = scratch.save(_verified_groups(groups, sets, num, den).union(
        _open_round(opened, vectors, sets, scratch, num, den)), "tree-links")
    label = components(links.union(more), scratch, "all")

    reps = classes.join(label, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("label", "cls").alias("label"))
    lowest = reps.groupBy("label").agg(F.min("rep").alias("component"))
    final = scratch.save(reps.join(lowest, "label").select("cls", "component"), "final")
    scratch.keep("rows", "final")
    return (rows.join(final, "cls", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component"))
                     .otherwise(F.col("doc_id")).alias("component_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80,
                     den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the smallest
    doc_id, and one of its rows if it repeats. Rows without an id stay."""
    scratch = Scratch(spark, "near-copies")
    found = jaccard_components(spark, docs, k, num, den)
    # what goes: an id whose component has a smaller one
    gone = scratch.save(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    small = gone.count() <= SMALL_IDS
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    again = scratch.save(found.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1")
                         .select("doc_id"), "repeated")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").union(once.select(*kept.columns))
