"""Ranked lexical search by two trees.

Documents are points whose coordinates are the impacts of the items' terms, items
are points of term weights. Both are held in hierarchies whose nodes carry
coordinate maxima. The product of two nodes' maxima bounds every score between
them; a pair of nodes whose bound lies below the weakest kth score of its items
is left out as a whole, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelspark.llm.common import map_arrow, text_blocks
from labelspark.session import settle

TOP = 50
SCALE = 1_000_000_000
FACTOR, LENGTH_FACTOR = 1_000, 20  # tf and length in the divisor of an impact
BASE, SHARE = 50, 50  # a document's m is BASE + SHARE * its length over the mean
WEIGHT = 1_000
ITEM_TERMS = 4_096  # terms of the items that are searched in one pass, about
POINT_CELLS = 4_000_000  # documents times terms that a task holds as one tree
LEAF, FANOUT = 32, 8  # documents in a leaf, children of a node
ITEM_LEAF, ITEM_FANOUT = 2, 4
SEEDS = 20_000  # documents whose scores give the first thresholds, about
MERGE_GROUPS = 64  # groups of an item's answers that are cut to the top before they meet

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[65:91] = np.arange(97, 123)
_WORD[97:123] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_ODD = 0xD6E8FEB86659FD93
_BACK = pow(_ODD, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_ODD, _BACK):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def term_hashes(raw: np.ndarray, where: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every term, term offsets of the texts).

    Terms are longest runs of ASCII letters and digits and of all bytes beyond
    ASCII; A-Z count as a-z.
    """
    low = _WORD[raw]
    inside = low > 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = where[1:] > where[:-1]
    first, last = where[:-1][filled], where[1:][filled] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = known
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * up[: len(low)], dtype=np.uint64, out=sums[1:])
    found = (sums[end] - sums[begin]) * down[begin]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29)), np.searchsorted(begin, where)


def hashed_texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, term offsets) for blocks of rows."""
    known = powers(1)
    for first, end, raw, where in text_blocks(texts):
        if len(known[0]) < len(raw) + 1:
            known = powers(len(raw) + 1)
        yield first, end, *term_hashes(raw, where, known)


def item_blocks(items: DataFrame, terms: int) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of about ``terms`` terms, one at a time on the
    driver. Rows of one id, null included, are one item."""
    whole = items.groupBy("item_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("text"))).alias("text"))
    load = whole.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, ceil(load / terms))
    for n in range(count):
        own = whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == n) if count > 1 else whole
        rows = sorted((tuple(r) for r in own.select("item_id", "text").collect()), key=repr)
        if rows:
            yield rows


def points_of(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, counts): a document's terms in all, and those of the
    sorted ``vocabulary`` it holds, as int32 places and counts."""

    def run(batches):
        for batch in batches:
            sizes, terms, counts = [], [], []
            for _, _, hashes, cuts in hashed_texts(batch.column(1)):
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
                hit = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                doc = np.searchsorted(cuts, hit, "right") - 1
                pair, number = np.unique(doc * max(1, len(vocabulary)) + place[hit], return_counts=True)
                own = np.searchsorted(pair // max(1, len(vocabulary)), np.arange(len(cuts)))
                term, number = (pair % max(1, len(vocabulary))).astype(np.int32), number.astype(np.int32)
                sizes += np.diff(cuts).tolist()
                terms += [term[a:b].tobytes() for a, b in zip(own, own[1:])]
                counts += [number[a:b].tobytes() for a, b in zip(own, own[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "terms", "counts"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {key}, n long, terms binary, counts binary")


def frequencies(points: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: one row of counts a task, added in Spark."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                total[np.frombuffer(held, np.int32)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["held"])

    rows = map_arrow(points.select("terms"), run, "held array<long>").select(F.posexplode("held").alias("term", "df"))
    out = np.zeros(size, np.int64)
    for term, df in rows.groupBy("term").agg(F.sum("df")).collect():  # a row for each term of the block
        out[term] = df
    return out


@dataclass
class Corpus:
    """What a score needs of all documents."""

    documents: int  # with at least one term
    length: int  # terms of all of them

    def weight(self, held: int) -> int:
        return floor(WEIGHT * log((2 * self.documents + 2) / (2 * held + 1)))

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term that occurs so often adds to a document of ``n`` terms, for
        a weight of one."""
        m = 100 - SHARE + SHARE * n * self.documents // max(1, self.length)
        return SCALE * counts // (FACTOR * counts + LENGTH_FACTOR * m)


class Tree:
    """Points in an order that keeps like ones together, and the coordinate maxima
    of runs of them: ``levels[0]`` of the leaves, the last of the root."""

    def __init__(self, points: np.ndarray, order: np.ndarray, leaf: int, fanout: int):
        self.points, self.leaf, self.fanout = points[order], leaf, fanout
        self.levels = [self._maxima(self.points, leaf)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self._maxima(self.levels[-1], fanout))

    @staticmethod
    def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
        return np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the level below; of level 0, the points."""
        size, total = (self.fanout, len(self.levels[level - 1])) if level else (self.leaf, len(self.points))
        out = (nodes[:, None] * size + np.arange(size)).reshape(-1)
        return out[out < total]


def item_order(weights: np.ndarray) -> np.ndarray:
    """Items one after the other so that neighbours share heavy terms."""
    left, order = list(range(len(weights))), []
    while left:
        pull = weights[left] @ weights[order[-1]] if order else weights[left].sum(axis=1)
        order.append(left.pop(int(pull.argmax())))
    return np.array(order, np.int64)


class Best:
    """The best documents of each item so far, and the score that a further one
    must reach."""

    def __init__(self, items: int, top: int, floors: np.ndarray):
        self.top, self.floor = top, floors.copy()
        self.held: list[pa.Table | None] = [None] * items

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        new = pa.table({"score": pa.array(scores), "doc_id": ids})
        if self.held[item] is not None:
            new = pa.concat_tables([self.held[item], new])
        if len(new) > self.top:  # equal scores by ascending id, nulls last
            new = new.take(pc.sort_indices(new, [("score", "descending"), ("doc_id", "ascending")])[: self.top])
            self.floor[item] = max(self.floor[item], new["score"][-1].as_py())
        self.held[item] = new


class Search:
    """All items of a block against documents, one tree of documents at a time."""

    def __init__(self, weights: np.ndarray, top: int, floors: np.ndarray):
        """``weights``: (items, terms), zero for terms an item lacks."""
        self.order = item_order(weights)
        self.items = Tree(weights, self.order, ITEM_LEAF, ITEM_FANOUT)
        self.best = Best(len(weights), top, floors)
        self.visited = self.scored = 0  # node pairs met, documents scored

    def _floor(self, level: int, node: int) -> int:
        """The weakest score that still counts for an item below the node."""
        nodes = np.array([node])
        while level >= 0:
            nodes = self.items.children(level, nodes)
            level -= 1
        return int(self.best.floor[self.order[nodes]].min())

    def run(self, points: np.ndarray, ids: pa.Array) -> None:
        """``points``: (documents, terms) impacts."""
        # documents that share their strongest term, and are alike in it, share leaves
        strong = points.argmax(axis=1)
        order = np.lexsort((points[np.arange(len(points)), strong], strong))
        self.docs, self.ids = Tree(points, order, LEAF, FANOUT), ids.take(pa.array(order))
        top = len(self.items.levels) - 1
        self._pair(top, 0, len(self.docs.levels) - 1, np.zeros(1, np.int64))

    def _pair(self, item_level: int, item: int, doc_level: int, docs: np.ndarray) -> None:
        """One item node against document nodes of one level."""
        maxima = self.items.levels[item_level][item]
        used = np.flatnonzero(maxima)
        bounds = self.docs.levels[doc_level][np.ix_(docs, used)] @ maxima[used]
        self.visited += len(docs)
        docs = docs[(bounds >= self._floor(item_level, item)) & (bounds > 0)]
        if not len(docs):
            return
        if doc_level:
            self._pair(item_level, item, doc_level - 1, self.docs.children(doc_level, docs))
        elif item_level:
            for child in self.items.children(item_level, np.array([item])):
                self._pair(item_level - 1, int(child), 0, docs)
        else:
            for place in self.items.children(0, np.array([item])):
                self._leaves(int(place), docs)

    def _leaves(self, place: int, leaves: np.ndarray) -> None:
        """One item against leaves, those of the highest bounds first."""
        weights, item = self.items.points[place], int(self.order[place])
        used = np.flatnonzero(weights)
        if not len(used):
            return
        bounds = self.docs.levels[0][np.ix_(leaves, used)] @ weights[used]
        ranked = np.argsort(-bounds, kind="stable")
        for at in range(0, len(ranked), 8):
            own = ranked[at : at + 8]
            own = own[(bounds[own] >= self.best.floor[item]) & (bounds[own] > 0)]
            if not len(own):
                return  # all others have lower bounds
            rows = self.docs.children(0, leaves[own])
            scores = self.docs.points[np.ix_(rows, used)] @ weights[used]
            self.scored += len(rows)
            good = np.flatnonzero((scores >= self.best.floor[item]) & (scores > 0))
            if len(good):
                self.best.add(item, scores[good], self.ids.take(pa.array(rows[good])))


def _answers(points: DataFrame, corpus: Corpus, weights: np.ndarray, top: int, floors: np.ndarray) -> DataFrame:
    """(item, doc_id, score): the best of each task, if they reach the floors."""
    held = points.schema["doc_id"].dataType.simpleString()

    def run(batches):
        search = Search(weights, top, floors)
        kind = pa.int64()
        size = max(LEAF, POINT_CELLS // max(1, weights.shape[1]))
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, len(batch), size):
                own = batch.slice(at, size)
                terms = [np.frombuffer(t, np.int32) for t in own.column(2).to_pylist()]
                counts = [np.frombuffer(c, np.int32) for c in own.column(3).to_pylist()]
                sizes = np.array([len(t) for t in terms])
                if not sizes.sum():
                    continue
                row = np.repeat(np.arange(len(own)), sizes)
                n = own.column(1).to_numpy()
                table = np.zeros((len(own), weights.shape[1]), np.int64)
                table[row, np.concatenate(terms)] = corpus.impacts(np.concatenate(counts).astype(np.int64), n[row])
                search.run(table, own.column(0))
        for item, found in enumerate(search.best.held):
            if found is not None:
                own = found.filter(pc.greater_equal(found["score"], int(floors[item]))).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), item, np.int32)), own["doc_id"].combine_chunks().cast(kind), own["score"].combine_chunks()],
                    ["item", "doc_id", "score"],
                )

    return map_arrow(points, run, f"item int, doc_id {held}, score long")


def _top(answers: DataFrame, top: int, *keys: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return answers.withColumn("rank", place).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents.

    A score adds, over the distinct terms that item and document share, the
    term's weight times an impact that grows with its count and falls with the
    document's length; all numbers are integers. Scores above zero count, equal
    ones rank by ascending doc_id, a null id last.

    Null and empty texts hold no term: such documents are never found and count
    neither among the documents nor in the mean length; such items find nothing.
    Rows with one item_id are one item; repeated documents are ranked each. With no
    documents or items the result is empty. Other columns are not read.

    The documents' terms are hashed once for a block of items and stored as short
    points; a block has about ITEM_TERMS terms, so what travels with a task is
    bounded. Scores of about SEEDS documents give every task a first threshold: the
    kth best of some is never above the kth best of all. Each task returns at most
    ``top`` rows an item, which are cut in groups before an item's rows meet.
    """
    key = items.schema["item_id"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, ITEM_TERMS):
        found = _search_block(docs, block, top)
        if found is not None:
            names = spark.createDataFrame([(i, block[i][0]) for i in range(len(block))], f"item int, item_id {key}")
            named = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            out = named if out is None else out.unionAll(named)
    return out if out is not None else spark.createDataFrame([], f"item_id {key}, rank int, doc_id {kind}, score long")


def _search_block(docs: DataFrame, block: list[tuple], top: int) -> DataFrame | None:
    own = [set()] * len(block)
    for first, end, hashes, cuts in hashed_texts(pa.array([t for _, t in block], pa.string())):
        own[first:end] = [set(hashes[a:b].tolist()) for a, b in zip(cuts, cuts[1:])]
    vocabulary = np.array(sorted(set().union(*own)), np.uint64)
    if not len(vocabulary):
        return None
    points = settle(points_of(docs, vocabulary), "points")
    row = points.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    corpus = Corpus(row[0] or 0, row[1] or 0)
    held = frequencies(points, len(vocabulary))
    weight_of = np.array([corpus.weight(int(n)) for n in held], np.int64)
    weights = np.zeros((len(block), len(vocabulary)), np.int64)
    for item, terms in enumerate(own):
        place = np.searchsorted(vocabulary, np.array(sorted(terms), np.uint64))
        weights[item, place] = weight_of[place]
    floors = np.ones(len(block), np.int64)
    filled = points.filter(F.octet_length("terms") > 0)
    share = min(1.0, SEEDS / max(1, corpus.documents))
    seeds = filled.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    ranked = _top(_answers(seeds, corpus, weights, top, floors), top, "item").filter(F.col("rank") == top)
    for item, score in ranked.select("item", "score").collect():  # one row an item
        floors[item] = max(1, score)
    answers = _answers(filled, corpus, weights, top, floors)
    group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_GROUPS))
    answers = _top(answers.withColumn("_group", group), top, "item", "_group").drop("_group", "rank")
    return _top(answers, top, "item")
