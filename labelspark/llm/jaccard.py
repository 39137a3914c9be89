"""Exact Jaccard join of word n-gram sets, by R-trees of count vectors.

Shingles are hashed into groups, and the number of a set's shingles in each group
is a point. Two sets share no more shingles than the sum of their coordinates'
minima. An R-tree over points holds coordinate maxima and the least size below
each node, so the same sum bounds a set against all sets of a node. Pairs that no
bound rules out are verified on the sets themselves.

No task can hold all points. Sets meet under shingles: with all shingles in one
order, frequent ones last, two sets that are similar enough share one of the first
few of each. The sets of a shingle make one tree, or several of bounded size;
shingles with the same sets make one between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.llm.common import fields_of, map_arrow, text_blocks
from labelspark.llm.components import components
from labelspark.session import settle

WORDS, PERCENT = 4, 85
GROUPS = 1_024  # coordinates of a point
LIKELY = 2  # shingles under which a set looks for its likeliest partner
LEAF, FANOUT = 16, 16
# A shingle with more sets than this is cut into blocks of about half as many.
TREE_ROWS = 4_096
SMALL = 8  # sets of a shingle that are compared without a tree
LISTED = 512  # shingles of a set up to which pairs are told apart by where they met first
HEAT_BITS = 18  # shingles are counted in so many hashed cells, as a power of two
HEAT_SLICES = 64
PAIR_CELLS = 2_000_000  # coordinates compared at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9FB21C651E98DF25
_BACK = pow(_ODD, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Shingler:
    """Sorted distinct shingle hashes of texts, a block of bytes at a time."""

    def __init__(self, words: int):
        self.words = words
        self.up = self.down = np.ones(1, np.uint64)
        self.factors = _mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def _word_hashes(self, raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < len(raw) + 1:
            self.up, self.down = _powers(_ODD, len(raw) + 1), _powers(_BACK, len(raw) + 1)
        inside = ~_SPACE[raw]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = where[1:] > where[:-1]
        first, last = where[:-1][filled], where[1:][filled] - 1
        starts[first], ends[last] = inside[first], inside[last]
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        sums = np.zeros(len(raw) + 1, np.uint64)
        # bytes count from one, so that a leading zero byte changes the hash too
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64, out=sums[1:])
        return _mixed((sums[end] - sums[begin]) * self.down[begin]), np.searchsorted(begin, where)

    def sets(self, texts: pa.Array):
        """The set of each text, in row order; null texts count as empty."""
        k = self.words
        for _, _, raw, where in text_blocks(texts):
            hashes, cuts = self._word_hashes(raw, where)
            grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
            for j in range(k):
                grams += hashes[j : j + len(grams)] * self.factors[j]
            grams = _mixed(grams)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= k:
                    yield np.unique(grams[a : b - k + 1])
                elif b > a:  # the whole text as one, told apart by its length
                    whole = (hashes[a:b] * self.factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                    yield _mixed(np.array([whole], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def least_overlap(a, b, percent: int):
    """Shingles that sets of sizes a and b must share: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """So many first shingles of a set of n: any set that is similar enough has one
    of them among its own first ones."""
    return n - -(-percent * n // 100) + 1


def counted(found: np.ndarray) -> bytes:
    """A set as a point: its shingles in each group. A byte each, after one that
    tells the unit as a power of two: large counts are rounded up to whole units,
    which keeps the bound."""
    counts = np.bincount((found & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    unit = max(0, int(counts.max()).bit_length() - 8)
    while -(-int(counts.max()) >> unit) > 255:
        unit += 1
    return bytes([unit]) + (-(-counts >> unit)).astype(np.uint8).tobytes()


def points_of(stored: list[bytes]) -> np.ndarray:
    """(sets, GROUPS) coordinates from their stored form."""
    held = np.frombuffer(b"".join(stored), np.uint8).reshape(-1, GROUPS + 1)
    return held[:, 1:].astype(np.int32) << held[:, :1] if held[:, 0].any() else held[:, 1:]


class CountTree:
    """An R-tree, packed from all points at once in the order of size and first
    coordinates. Nodes hold coordinate maxima, least and largest size."""

    def __init__(self, points: np.ndarray, n: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((points[:, 1], points[:, 0], n))
        self.points, self.n = points, n
        rows, size = points[self.order], n[self.order]
        # level 0 holds the points themselves
        self.upper, self.least, self.most = [rows], [size], [size]
        width = LEAF
        while len(self.upper[-1]) > 1:
            at = np.arange(0, len(self.upper[-1]), width)
            self.upper.append(np.maximum.reduceat(self.upper[-1], at, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], at))
            self.most.append(np.maximum.reduceat(self.most[-1], at))
            width = FANOUT

    def _keep(self, level: int, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        size = self.n[query]
        least = np.maximum(self.least[level][node], -(-self.percent * size // 100))
        good = (least <= self.most[level][node]) & (self.percent * self.least[level][node] <= 100 * size)
        out = np.zeros(len(query), bool)
        place = np.flatnonzero(good)
        step = max(1, PAIR_CELLS // GROUPS)
        for at in range(0, len(place), step):
            own = place[at : at + step]
            bound = np.minimum(self.points[query[own]], self.upper[level][node[own]]).sum(axis=1, dtype=np.int64)
            out[own] = bound >= least_overlap(size[own], least[own], self.percent)
        return out

    def search(self, queries: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs that no bound rules out; points not ``open_`` are
        passed over. Queries are places of the tree's own points."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = [open_[self.order] if open_ is not None else np.ones(len(self.n), bool)]
        for level in range(1, len(self.upper)):
            live.append(np.logical_or.reduceat(live[-1], np.arange(0, len(live[-1]), LEAF if level == 1 else FANOUT)))
        for at in range(0, len(queries), 256):
            own = queries[at : at + 256]
            top = len(self.upper) - 1
            query, node = np.repeat(own, len(self.upper[top])), np.tile(np.arange(len(self.upper[top])), len(own))
            for level in range(top, -1, -1):
                alive = live[level][node]
                query, node = query[alive], node[alive]
                kept = self._keep(level, query, node)
                query, node = query[kept], node[kept]
                if level:
                    width, total = (LEAF if level == 1 else FANOUT), len(self.upper[level - 1])
                    query = np.repeat(query, width)
                    node = (node[:, None] * width + np.arange(width)).reshape(-1)
                    query, node = query[node < total], node[node < total]
            found.append((query, self.order[node]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + [q for q, _ in found]), np.concatenate(none + [p for _, p in found])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs that no bound rules out, as far as every
        tree of it is reached from its largest set."""
        open_ = np.ones(len(self.n), bool)
        us, vs = [], []
        for seed in np.argsort(-self.n, kind="stable"):
            if not open_[seed]:
                continue
            open_[seed] = False
            queue = np.array([seed])
            while len(queue) and open_.any():
                query, point = self.search(queue, open_)
                point, first = np.unique(point, return_index=True)
                us.append(query[first])
                vs.append(point)
                open_[point] = False
                queue = point
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + us), np.concatenate(none + vs)


def likeness(points: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(most shingles that pairs can share, the similarity that would be)."""
    most = np.empty(len(a), np.int64)
    step = max(1, PAIR_CELLS // GROUPS)
    for at in range(0, len(a), step):
        own = slice(at, at + step)
        most[own] = np.minimum(points[a[own]], points[b[own]]).sum(axis=1, dtype=np.int64)
    most = np.minimum(most, np.minimum(n[a], n[b]))
    return most, most / (n[a] + n[b] - most)


def _pairs(across: bool, percent: int):
    """Over rows (token, tile, node, n, label, major, points, earlier) sorted by token
    and tile: candidate pairs (u, v, likeness) of each group.

    ``across`` asks for all pairs of different labels; ``major`` marks rows that
    need not meet each other. ``earlier`` are the smaller tokens under which
    the set stands too, null if they are too many or the group is small: a pair that
    has one in common was found there. Otherwise the likeliest pair of each set of a
    small group, or a forest of a large one, is enough.
    """

    def of(group: np.ndarray, rows: dict[str, np.ndarray], points: np.ndarray):
        node, n, label = rows["node"], rows["n"], rows["label"]
        cut = np.flatnonzero(np.diff(group)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(group)]
        sizes = ends - starts
        small = np.repeat(sizes <= SMALL, sizes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, SMALL):  # small groups: all at once, by distance in the sort order
            if len(group) <= d:
                break
            x = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            y = x + d
            close = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            if across:
                close &= label[x] != label[y]
            found.append((x[close], y[close]))
        for g in np.flatnonzero(sizes > SMALL):
            own = slice(starts[g], ends[g])
            if across and (label[own] == label[starts[g]]).all():
                continue
            tree = CountTree(points[own], n[own], percent)
            if across:
                x, y = tree.search(np.flatnonzero(~rows["major"][own]))
                apart = label[own][x] != label[own][y]
                x, y = x[apart], y[apart]
            else:
                x, y = tree.forest()
            found.append((x + starts[g], y + starts[g]))
        x = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
        y = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
        most, like = likeness(points, n, x, y)
        good = (most >= least_overlap(n[x], n[y], percent)) & (node[x] != node[y])
        x, y, like = x[good], y[good], like[good]
        if across and len(x):
            first, known = np.ones(len(x), bool), rows["earlier"]
            for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
                if known[a] is not None and known[b] is not None:
                    first[i] = known[a].isdisjoint(known[b])
            x, y, like = x[first], y[first], like[first]
        if not across:  # the likeliest partner of each member, whichever side it stands on
            side, other, score = np.r_[x, y], np.r_[y, x], np.r_[like, like]
            order = np.lexsort((node[other], -score, side))
            first = order[np.r_[True, np.diff(side[order]) != 0]] if len(order) else order
            x, y, like = side[first], other[first], score[first]
        u, v = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
        order = np.lexsort((v, u))
        order = order[np.r_[True, (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)]] if len(order) else order
        return u[order], v[order], like[order]

    def run(batches):
        held: tuple | None = None

        def flush(upto: int):
            keys, rows, points = held
            new = np.r_[True, (keys[1:upto] != keys[: upto - 1]).any(axis=1)]
            found = of(np.cumsum(new), {k: r[:upto] for k, r in rows.items()}, points[:upto])
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["u", "v", "likeness"])

        for batch in batches:
            if not len(batch):
                continue
            column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            keys = np.column_stack([column["token"].to_numpy(), column["tile"].to_numpy().astype(np.int64)])
            rows = {f: column[f].to_numpy(zero_copy_only=False) for f in ("node", "n", "label", "major")}
            rows["earlier"] = np.empty(len(batch), object)
            if across:
                rows["earlier"][:] = [None if e is None else frozenset(e) for e in column["earlier"].to_pylist()]
            points = points_of(column["points"].to_pylist())
            if held is not None:
                keys = np.concatenate([held[0], keys])
                rows = {f: np.concatenate([held[1][f], r]) for f, r in rows.items()}
                points = np.concatenate([held[2], points])
            held = (keys, rows, points)
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield flush(last)
                held = (keys[last:], {f: r[last:] for f, r in rows.items()}, points[last:])
        if held is not None:
            yield flush(len(held[0]))

    return run


def shingle_heat(docs: DataFrame, words: int) -> np.ndarray:
    """How far each hashed cell of shingles lies above the common load, as the bit
    length of the excess: 0 for most. Each task adds a vector of fixed size for all
    its documents; slices of it are added in Spark."""
    width = 1 << HEAT_BITS

    def count(batches):
        total, shingler = np.zeros(width, np.int64), Shingler(words)
        for batch in batches:
            for found in shingler.sets(batch.column(0)):
                np.add.at(total, (found >> np.uint64(64 - HEAT_BITS)).astype(np.int64), 1)
        parts = total.reshape(HEAT_SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(HEAT_SLICES, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.int64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"]
        )

    kind = "slice int, counts binary"
    added = map_arrow(map_arrow(docs.select("text"), count, kind).repartition(HEAT_SLICES, "slice"), add, kind)
    total = np.zeros((HEAT_SLICES, width // HEAT_SLICES), np.int64)
    for part, counts in added.collect():  # HEAT_SLICES rows, two megabytes in all
        total[part] = np.frombuffer(counts, np.int64)
    total = total.reshape(-1)
    # a load that a cell of rare shingles hardly ever exceeds
    common = total.mean() + 6 * np.sqrt(total.mean()) + 8
    return np.array([int(x).bit_length() for x in np.maximum(0, total - common)], np.uint8)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with n_shingles and set_key (16 bytes of a hash, null if the set is
    empty) in place of text."""
    others = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            n, keys = [], []
            for found in shingler.sets(batch.column(at)):
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64()), pa.array(keys, pa.binary())], [*others, "n_shingles", "set_key"]
            )

    return map_arrow(docs, run, fields_of(docs.select(*others)) + ", n_shingles long, set_key binary")


def count_points(texts: DataFrame, words: int) -> DataFrame:
    """(node, n_shingles, points) of (node, text)."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            n, points = [], []
            for found in shingler.sets(batch.column(1)):
                n.append(len(found))
                points.append(counted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(points, pa.binary())], ["node", "n_shingles", "points"]
            )

    return map_arrow(texts.select("node", "text"), run, "node long, n_shingles long, points binary")


def postings(texts: DataFrame, words: int, percent: int, heat: np.ndarray) -> DataFrame:
    """(token, node): a row for each shingle of the prefix of each set. The order of
    shingles is that of ``heat``, then of their hashes: any order that is the same for
    all sets will do, and this one puts frequent shingles last."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            nodes, tokens, held = [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes))], ["token", "node"])

            for node, found in zip(batch.column(0).to_numpy().tolist(), shingler.sets(batch.column(1))):
                if not len(found):
                    continue
                hot = heat[(found >> np.uint64(64 - HEAT_BITS)).astype(np.int64)]
                ranked = found[np.argsort(hot, kind="stable")] if hot.any() else found
                tokens.append(ranked[: prefix_size(len(found), percent)])
                nodes.append(np.full(len(tokens[-1]), node, np.int64))
                held += len(tokens[-1])
                if held > 100_000:
                    yield flush()
                    nodes, tokens, held = [], [], 0
            if tokens:
                yield flush()

    return map_arrow(texts.select("node", "text"), run, "token long, node long")


def _grouped(rows: DataFrame, across: bool, percent: int) -> DataFrame:
    """(u, v, likeness) candidates of rows (token, tile, node, n, label, major, points, earlier)."""
    rows = rows.select("token", "tile", "node", F.col("n_shingles").alias("n"), "label", "major", "points", "earlier")
    dealt = rows.repartition("token", "tile").sortWithinPartitions("token", "tile")
    return map_arrow(dealt, _pairs(across, percent), "u long, v long, likeness double")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough.

    The text of each v travels to its u, whose own text comes once, or once for
    each part of a u with more than TREE_ROWS pairs. Sets are made again there.
    """
    counts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("parts"))
    whole = texts.select("node", "text")
    hubs = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(whole.withColumnRenamed("node", "u"), "u")
    many = settle(counts.filter(F.col("parts") > 1), "hubs")
    part = F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")
    ends = pairs.select("u", "v").join(many, "u", "left").withColumn("part", part).join(whole.withColumnRenamed("node", "v"), "v")
    both = hubs.select("u", "part", F.lit(None).cast("long").alias("v"), "text").unionAll(ends.select("u", "part", "v", "text"))
    dealt = both.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))

    def compare(batches):
        shingler, hub, own = Shingler(words), None, None
        for batch in batches:
            us, vs = [], []
            for u, v, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingler.sets(batch.column(3))):
                if v is None:
                    hub, own = u, found
                    continue
                if u != hub:
                    raise ValueError("a pair came before its first text")
                shared = len(own) + len(found) - len(np.union1d(own, found))
                if shared >= least_overlap(len(own), len(found), percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return settle(map_arrow(dealt, compare, "u long, v long"), "verified")


def _meetings(texts: DataFrame, words: int, percent: int, heat: np.ndarray) -> DataFrame:
    """(token, node, k): a stored table of the shingles that k > 1 sets have in
    their prefixes, one for each different collection of sets."""
    found = postings(texts, words, percent, heat)
    shared = settle(found.groupBy("token").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1), "shared")
    members = settle(found.join(shared, "token"), "members")
    same = [F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")]
    of = members.groupBy("token").agg(F.max("k").alias("k"), *same)
    kept = settle(of.groupBy("k", "a", "b").agg(F.min("token").alias("token")).select("token"), "kept")
    return settle(members.join(kept, "token"), "meetings").select("token", "node", "k")


def _likely_links(meetings: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(u, v): the likeliest partner of each set, as far as a few trees of bounded
    size show it: those of the LIKELY shingles that most sets share with it. Crowded
    shingles are cut into blocks at random; what that misses is left to ``_open_links``."""
    widest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("k"), "token"))
    rows = meetings.withColumn("_rank", widest).filter(F.col("_rank") <= LIKELY)
    blocks = F.ceil(F.col("k") / (TREE_ROWS // 2)).cast("int")
    tile = F.when(F.col("k") > TREE_ROWS, F.pmod(F.xxhash64("node", "token"), blocks)).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("tile", tile).select("token", "tile", "node").join(points, "node")
    unused = {"label": F.lit(0).cast("long"), "major": F.lit(False), "earlier": F.lit(None).cast("array<bigint>")}
    found = _grouped(rows.withColumns(unused), False, percent)
    ends = found.select(F.explode(F.array("u", "v")).alias("node"), "u", "v", "likeness")
    best = ends.groupBy("node").agg(F.max(F.struct("likeness", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))).alias("best"))
    return best.select((-F.col("best.u")).alias("u"), (-F.col("best.v")).alias("v")).distinct()


def _open_links(meetings: DataFrame, points: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v): all candidates between different labels, under all prefix shingles.

    Shingles whose sets have one label are left out by minimum and maximum. In a
    crowded one, sets of the commonest label need not meet: each goes to one block,
    the others to all, so rows are its sets plus the others times the blocks.
    """
    labelled = settle(meetings.join(labels, "node"), "labelled")
    open_ = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    members = settle(labelled.join(open_.filter(F.col("low") != F.col("high")).select("token"), "token"), "open")
    crowded = members.filter(F.col("k") > TREE_ROWS).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    most = F.max(F.struct("n", "label")).alias("most")
    crowded = crowded.groupBy("token").agg(most, F.max("k").alias("k")).select(
        "token", F.col("most.label").alias("common"), F.ceil(F.col("k") / (TREE_ROWS // 2)).cast("int").alias("blocks")
    )
    crowded = settle(crowded, "crowded")
    major = F.coalesce(F.col("label") == F.col("common"), F.lit(False))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(major, own).otherwise(every)
    rows = members.join(crowded, "token", "left").select("token", "node", "label", "k", major.alias("major"), F.explode(tiles).alias("tile"))
    # as long as one set's prefix; in small groups a pair may as well come again
    listed = members.groupBy("node").agg(F.collect_list("token").alias("_tokens"))
    rows = rows.join(points.join(listed, "node"), "node")
    earlier = F.when((F.size("_tokens") <= LISTED) & (F.col("k") > SMALL), F.filter("_tokens", lambda t: t < F.col("token")))
    return _grouped(rows.withColumn("earlier", earlier), True, percent).select("u", "v").distinct()


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    A text's set is its distinct shingles of ``words`` words (runs without blanks,
    A-Z lower-cased); with fewer words the whole sequence is the only one. Texts
    link when 100 * intersection >= ``percent`` * union; ``component_id`` is the
    smallest doc_id that chains of links reach, the row's own included.

    A null, empty or blank text has an empty set, which links with nothing, not
    even another one. Equal sets are one point, however many rows have them. A
    null doc_id gets the smallest id of its component, null if there is none;
    repeated rows come back as often as they came in; no rows give none. Other
    columns are not read. Shingles are compared by 64-bit hashes.

    In a first round each set is verified with its likeliest partner only; that
    joins most of each component. In the second, all pairs of different components
    that no bound rules out are verified, so no link between components is lost.
    """
    names = []
    for name in ("_file", "_row"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    place = F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])
    try:
        rows = docs.select("doc_id", "text", *place)
    except AnalysisException:  # not from files: a row has no place yet
        rows = settle(docs.select("doc_id", "text"), "documents").select("doc_id", "text", *place)
    marked = settle(signatures(rows, words), "signatures")
    chosen = F.min(F.struct(*names)).alias("place")
    distinct = marked.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("first_doc"), chosen)
    sets = settle(distinct.select("set_key", "first_doc", "place.*").withColumn("node", F.monotonically_increasing_id()), "sets")
    texts = settle(rows.select("text", *names).join(sets.select("node", *names), names).select("node", "text"), "texts")
    meetings = _meetings(texts, words, percent, shingle_heat(texts, words))
    # from here on only sets that meet another one
    met = meetings.select("node").distinct()
    texts = settle(texts.join(met, "node"), "met")
    points = settle(count_points(texts, words), "points")
    linked = components(_verified(settle(_likely_links(meetings, points, percent), "pairs"), texts, words, percent))
    labels = settle(met.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("label")), "labels")
    more = _verified(settle(_open_links(meetings, points, labels, percent), "pairs"), texts, words, percent)
    edges = more.join(labels.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("b")), "v"
    )
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "label")
    whole = labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    rooted = sets.select("set_key", "first_doc", "node").join(whole, "node", "left").select(
        "set_key", "first_doc", F.coalesce("root", "node").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_doc").alias("component"))
    named = settle(rooted.join(firsts, "root").select("set_key", "component"), "named")
    found = marked.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))
