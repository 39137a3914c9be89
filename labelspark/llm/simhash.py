"""Near duplicates by SimHash, found with the generalised pigeonhole principle.

64-bit fingerprints within ``max_distance`` bits are linked. The bits are cut
into partitions, each with a threshold of its own; if the thresholds plus one
sum to ``max_distance + 1``, every linked pair agrees within the threshold in at
least one partition. Correlated bits go into one partition, and partition widths
and thresholds come from a dynamic programme over expected candidate counts.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import fields_of, map_arrow
from labelspark.llm.components import components
from labelspark.session import settle

SEED = 42
BITS = 64
CELL = 4  # bits per histogram cell; partitions are runs of whole cells
# A probe key with more rows than this is cut into tiles of about this many.
TILE_ROWS = 4096
# Costs in the dynamic programme: one probe row against one candidate pair.
ROW_COST, PAIR_COST = 1.0, 0.1


def fingerprint(raw: bytes, words: int) -> int:
    """SimHash of the word shingles of one text; repeats count.

    Fewer words than ``words``: one shingle of all of them. No word: zero.
    """
    tokens = raw.lower().split()  # on bytes: A-Z only, and splits at \\x20 \\x09-\\x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    last = max(0, len(tokens) - words)
    spans = zip(starts[: last + 1].tolist(), ends[min(words, len(tokens)) - 1 :].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` with fp in place of text: one row per document. A null text counts as empty."""
    at = docs.columns.index("text")
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            prints = [fingerprint((t.as_py() or "").encode(), words) for t in batch.column(at)]
            prints = np.array(prints, np.uint64).view(np.int64)
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints)], [*others, "fp"])

    return map_arrow(docs, run, fields_of(docs.select(*others)) + ", fp long")


def bit_matrix(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(prints: DataFrame, size: int, count) -> np.ndarray:
    """Sum over all fingerprints of a ``size``-vector that ``count`` makes of a block."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 65_536):
                total += count(values[at : at + 65_536])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counts"])

    rows = map_arrow(prints.select("fp"), run, "counts array<long>").select(F.posexplode("counts").alias("i", "n"))
    out = np.zeros(size, np.int64)
    for i, n in rows.groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def group_bits(together: np.ndarray, total: int) -> list[int]:
    """An order of the bits in which correlated bits share a cell."""
    share = np.diag(together) / max(1, total)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    tied = np.abs(together / max(1, total) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0.0)
    left, order = set(range(BITS)), []
    while left:
        pool = sorted(left)
        pull = tied[:, order[-CELL:]].sum(axis=1) if order else tied.sum(axis=1)
        cell = [max(pool, key=lambda b: (pull[b], -b))]
        while len(cell) < CELL:
            rest = [b for b in pool if b not in cell]
            cell.append(max(rest, key=lambda b: (tied[b, cell].sum(), -b)))
        order += cell
        left -= set(cell)
    return order


def allocate(cells: np.ndarray, total: int, max_distance: int) -> list[tuple[int, int, int]]:
    """(first cell, end cell, threshold) per partition, at the smallest cost.

    ``cells[c, v]`` counts fingerprints with value v in cell c. The expected
    number of candidates of a partition follows from its cells' distance
    distributions. Thresholds of -1 (partition unused) are allowed.
    """
    n_cells = len(cells)
    value = np.arange(cells.shape[1])
    apart = np.array([[int(a ^ b).bit_count() for a in value] for b in value])
    shares = cells / max(1, total)
    near = np.zeros((n_cells, CELL + 1))
    for c in range(n_cells):
        both = np.outer(shares[c], shares[c])
        near[c] = [both[apart == d].sum() for d in range(CELL + 1)]

    def cost(a: int, b: int, units: int) -> float:
        if not units:
            return 0.0
        law = np.ones(1)
        for c in range(a, b):
            law = np.convolve(law, near[c])[: units + 1]
        rows = probe_count((b - a) * CELL, units - 1)
        return total * rows * ROW_COST + 0.5 * total * total * law[:units].sum() * PAIR_COST

    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for end in range(1, n_cells + 1):
        for units in range(max_distance + 2):
            options = [
                (best[a, units - u][0] + cost(a, end, u), best[a, units - u][1] + [(a, end, u - 1)])
                for a in range(end)
                for u in range(units + 1)
                if (a, units - u) in best
            ]
            if options:
                best[end, units] = min(options, key=lambda o: (o[0], len(o[1])))
    return [p for p in best[n_cells, max_distance + 1][1] if p[2] >= 0]


def probe_count(width: int, threshold: int) -> int:
    """Keys per fingerprint: two values within ``threshold`` bits share one."""
    return sum(comb(width, r) for r in range((threshold + 1) // 2 + 1))


def probe_masks(width: int, threshold: int) -> np.ndarray:
    """XOR masks of up to half the threshold (rounded up) bits: both sides of a
    pair within the threshold reach a common value."""
    masks = [0]
    for r in range(1, (threshold + 1) // 2 + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(width), r)]
    return np.array(masks, np.uint64)


def _probes(prints: DataFrame, order: list[int], plan: list[tuple[int, int, int]]) -> DataFrame:
    """(part, key, fp) for every partition and mask."""

    def run(batches):
        parts = []
        for part, (a, b, threshold) in enumerate(plan):
            bits = order[a * CELL : b * CELL]
            parts.append((part, bits, probe_masks(len(bits), threshold)))
        step = max(1, 200_000 // max(1, sum(len(m) for _, _, m in parts)))
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), step):
                own = values[at : at + step]
                matrix = bit_matrix(own).astype(np.uint64)
                for part, bits, masks in parts:
                    base = np.zeros(len(own), np.uint64)
                    for place, bit in enumerate(bits):
                        base |= matrix[:, bit] << np.uint64(place)
                    keys = (base[:, None] ^ masks[None, :]).reshape(-1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(np.repeat(own, len(masks)))],
                        ["part", "key", "fp"],
                    )

    return map_arrow(prints.select("fp"), run, "part int, key long, fp long")


def group_links(prints: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one key."""
    open_, us, vs = np.unique(prints), [], []
    queue: list = []
    while len(open_) or queue:
        if not queue:
            queue.append(open_[0])
            open_ = open_[1:]
        one = queue.pop()
        close = np.bitwise_count((open_ ^ one).view(np.uint64)) <= max_distance
        if close.any():
            found = open_[close]
            us.append(np.full(len(found), one))
            vs.append(found)
            queue.extend(found)
            open_ = open_[~close]
    none = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links(max_distance: int):
    """Over rows sorted by (part, key, tile): links of each group, verified exactly."""

    def of(group_ids: np.ndarray, prints: np.ndarray):
        us, vs = [], []
        cut = np.flatnonzero(np.diff(group_ids)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(prints)]
        sizes = ends - starts
        for d in range(1, 8):  # small groups: all at once, by distance in the sort order
            same = group_ids[d:] == group_ids[:-d]
            small = np.repeat(sizes <= 8, sizes)[d:]
            x, y = prints[:-d], prints[d:]
            hit = same & small & (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= max_distance)
            us.append(x[hit])
            vs.append(y[hit])
        for g in np.flatnonzero(sizes > 8):
            u, v = group_links(prints[starts[g] : ends[g]], max_distance)
            us.append(u)
            vs.append(v)
        return np.concatenate(us), np.concatenate(vs)

    def run(batches):
        held = None
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)])
            if held is not None:
                rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)]
            last = int(np.flatnonzero(new)[-1])
            held = rows[last:]
            if last:
                u, v = of(np.cumsum(new[:last]), rows[:last, 3])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if held is not None and len(held):
            u, v = of(np.zeros(len(held), np.int64), held[:, 3])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def links(prints: DataFrame, max_distance: int) -> DataFrame:
    """(u, v): edges between distinct fingerprints that connect exactly those
    that chains of links connect.

    ``prints``: a stored table with distinct column fp. Each key's group gives a
    spanning forest, never all its pairs. A key with more than TILE_ROWS rows is
    cut into blocks, and each pair of blocks is a group of its own, so that every
    pair still meets in one bounded group.
    """
    total = prints.count()
    together = _summed(
        prints, BITS * BITS, lambda v: np.rint((m := bit_matrix(v).astype(np.float32)).T @ m).astype(np.int64).reshape(-1)
    ).reshape(BITS, BITS)
    order = group_bits(together, total)

    def cell_values(v: np.ndarray) -> np.ndarray:
        bits = bit_matrix(v)[:, order].reshape(-1, BITS // CELL, CELL)
        codes = bits @ (1 << np.arange(CELL)) + np.arange(BITS // CELL) * (1 << CELL)
        return np.bincount(codes.reshape(-1), minlength=BITS // CELL << CELL)

    cells = _summed(prints, BITS // CELL << CELL, cell_values).reshape(BITS // CELL, 1 << CELL)
    plan = allocate(cells, total, max_distance)
    probes = _probes(prints, order, plan)
    # grows with the number of crowded keys only; Spark sees its stored size
    crowded = settle(
        probes.groupBy("part", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > TILE_ROWS)
        .select("part", "key", F.ceil(F.col("n") / (TILE_ROWS // 2)).cast("int").alias("blocks")),
        "crowded",
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiles = F.transform(other, lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j))
    tiled = probes.join(crowded, ["part", "key"], "left").select(
        "part", "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(tiles)).alias("tile"), "fp"
    )
    dealt = tiled.repartition("part", "key", "tile").sortWithinPartitions("part", "key", "tile")
    return map_arrow(dealt, _links(max_distance), "u long, v long")


def grouped(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with fp, root (the same for all rows of a component) and
    component_id in place of text. ``docs`` has doc_id, text and what else is to
    be carried along; fp, root and component_id must be new."""
    prints = settle(fingerprints(docs, words), "prints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    found = components(links(distinct, max_distance))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    firsts = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = settle(rooted.join(firsts, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    doc_id that chains of links reach, the row's own included. Empty and null
    texts have fingerprint zero and are linked with each other. A null doc_id
    gets the smallest id of its component, null if there is none. Repeated rows
    come back as often as they came in. Other columns are not read.
    """
    return grouped(docs.select("doc_id", "text"), words, max_distance).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, words: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with exactly one row of each component: the one of smallest doc_id,
    the first stored one where ids repeat or all are null. All columns stay.

    A row is known by its file and its place in it; ``docs`` that do not come from
    files are stored first.
    """
    names = []
    for name in ("_file", "_row"):
        while name in docs.columns:
            name += "_"
        names.append(name)
    file, row = names
    place = F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        docs = settle(docs, "documents")
        rows = docs.select("*", *place)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", file, row)).alias("first")
    found = grouped(rows.select("doc_id", "text", *names), words, max_distance)
    kept = found.groupBy("root").agg(first).select(f"first.{file}", f"first.{row}")
    return rows.join(kept, names, "left_semi").select(*docs.columns)
