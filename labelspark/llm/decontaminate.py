"""Benchmark items inside documents, small edits included.

Item-sized word windows are embedded by a shared random walk (CGK) that turns
edit distance into Hamming distance. Sampled places of the embedding are hash
keys; an item and a window that share a key are compared by exact edit distance.

An edit breaks at most two adjacent word pairs, so a stretch that holds an item
has a known number of the item's pairs. Windows outside all stretches with so
many pairs of any item are not embedded, which loses nothing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelspark.llm.common import fields_of, map_arrow, text_blocks

MIN_SIMILARITY = 0.8  # 1 - word edits / words of the item
MIN_WORDS = 2  # items of one word say too little and never match
EXACT_WORDS = 5  # shorter items allow no edit and are looked up whole
SIZE_STEP = 1.25  # items whose lengths differ by less share one bound on word pairs
MAX_WINDOW = 16  # walks lose step with length, so long items get more windows, not longer ones
SAMPLES = 4  # places of the embedding in one key
SHORT_SAMPLES = 3  # the same for windows below eight words, which one edit changes most
TABLES_PER_WALK = 8
TARGET_RECALL = 0.95
# Share of places that a window keeps at the edits allowed, set so that measured
# recall reaches the target: whole short items, and windows inside an item.
SHORT_MATCH, MATCH = 0.45, 0.58
SEED = 5
# Items are searched in blocks of about this many keys, each in one pass over
# the documents; a block travels with the tasks (8 bytes a key, and a bit table).
BLOCK_KEYS = 2_000_000
FILTER_BITS = 8  # bits of the table per key, as a power of two

_WORD = np.zeros(256, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
# first bytes of three-byte letters of scripts without blanks (kana, Han): each is a word
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEA] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)
_PAD = np.uint64(0x2545F4914F6CDD1D)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(raw: np.ndarray, where: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, word offsets of the texts).

    Words are runs of letters and digits, bytes beyond ASCII included; kana and
    Han letters are words of their own, as no blank parts them. The hash is a
    polynomial modulo 2**64, read off running sums.
    """
    low = _WORD[raw]
    inside = low > 0
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    before[where[:-1][where[:-1] < len(low)]] = False
    after = np.r_[inside[1:], False] if len(inside) else inside
    after[where[1:-1][where[1:-1] > 0] - 1] = False
    alone = np.flatnonzero(_ALONE[raw])
    if len(alone):
        follow, lead = alone + 3, alone - 1
        before[alone] = after[alone + 2] = False
        before[follow[follow < len(low)]] = False
        after[lead[lead >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = powers
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)], dtype=np.uint64)]
    found = (sums[ends] - sums[starts]) * down[starts]
    found ^= found >> np.uint64(29)
    return found * np.uint64(0xBF58476D1CE4E5B9), np.searchsorted(starts, where)


def window_words(words: int) -> int:
    """Window length for an item: a power of two of at most two thirds of it, and
    of MAX_WINDOW, so that a passage holds several windows on any grid; short
    items: themselves."""
    if words < 8:
        return words
    return min(MAX_WINDOW, 1 << int(max(8, 2 * words // 3)).bit_length() - 1)


def samples_of(words: int) -> int:
    return min(words, SAMPLES if words >= 8 else SHORT_SAMPLES)


@dataclass
class Layer:
    """Windows of one length: grid step, and the sampled places of each walk."""

    words: int
    stride: int
    walks: list[tuple[np.ndarray, np.ndarray]]  # (move multipliers, (tables, samples) places)


def layers_for(sizes: list[int]) -> list[Layer]:
    """One layer per window length among items of these sizes, with as many
    tables as TARGET_RECALL needs for the item that holds the fewest windows.

    Only windows that share no word count as independent trials.
    """
    out = []
    for words in sorted({window_words(n) for n in sizes}):
        shortest = min(n for n in sizes if window_words(n) == words)
        stride = max(1, min(words // 4, shortest - words + 1))
        windows = (shortest - stride + 1) // words
        samples = samples_of(words)
        keep = (MATCH if words >= 8 else SHORT_MATCH) ** samples
        tables = ceil(log(1 - TARGET_RECALL) / (max(1, windows) * log(1 - keep)))
        rng = np.random.default_rng([SEED, words])
        walks = []
        steps = max(1, 3 * words // 2)  # a walk moves on every second step
        for _ in range(ceil(tables / TABLES_PER_WALK)):
            cuts = np.linspace(0, steps, samples + 1).astype(int)
            places = np.stack([rng.integers(a, b, TABLES_PER_WALK) for a, b in zip(cuts, cuts[1:])], axis=1)
            walks.append((rng.integers(0, 1 << 31, steps, np.uint32) * np.uint32(2) + np.uint32(1), places))
        out.append(Layer(words, stride, walks))
    return out


def keys_of(hashes: np.ndarray, starts: np.ndarray, layer: Layer) -> np.ndarray:
    """(tables, windows) keys of the windows that begin at ``starts``.

    At each step a walk writes the word it stands on and moves on, or not, by a
    coin that depends on the step and the word alone. Only the sampled places
    are kept. ``hashes`` must go on for ``layer.words`` after the last window: the
    few walks that leave their window read on there.
    """
    out = []
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for number, (moves, places) in enumerate(layer.walks):
        keys = np.full((len(places), len(starts)), np.uint64(layer.words * 64 + number), np.uint64)
        at = starts.astype(np.int64)
        for step in range(int(places.max()) + 1):
            word = short.take(at)
            used = np.flatnonzero((places == step).any(axis=1))
            if len(used):
                whole = hashes.take(at)
                for t in used:
                    keys[t] = (keys[t] ^ whole) * np.uint64(_BASE)
                    keys[t] ^= keys[t] >> np.uint64(31)
            at += (word * moves[step]) >> np.uint32(31)
        out.append(keys + np.arange(len(places), dtype=np.uint64)[:, None] * np.uint64(_BACK))
    return np.concatenate(out)


def edit_ends(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Fewest word edits from the item to a stretch of the region, for each end."""
    place = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[0] = i
        step[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(step - place) + place
    return row


@dataclass
class Block:
    """Some items, ready for a pass over the documents."""

    ids: list
    words: list[np.ndarray]
    layers: list[Layer]
    keys: np.ndarray  # sorted
    owners: np.ndarray  # item of each key
    offsets: np.ndarray  # word of the item at which the window of the key begins
    pairs: np.ndarray  # sorted hashes of adjacent words of all items
    bounds: dict[int, list[tuple[int, int]]]  # window length → (stretch, pairs it must hold)


def allowed_edits(words: int) -> int:
    return floor((1 - MIN_SIMILARITY) * words + 1e-9)


def least_pairs(words: int) -> int:
    """Adjacent word pairs that are left of an item after the edits allowed."""
    return max(0, words - 1 - 2 * allowed_edits(words))


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and its next one (one fewer than words)."""
    found = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(31))) * np.uint64(_BASE) + hashes[1:]
    return found ^ (found >> np.uint64(29))


def size_bounds(sizes: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each window length, (longest stretch, fewest pairs) of classes of items
    of similar length: what any item of the class leaves in a text."""
    out: dict[int, list[tuple[int, int]]] = {}
    for words in sorted({window_words(n) for n in sizes}):
        own = sorted({n for n in sizes if window_words(n) == words})
        while own:
            group = [n for n in own if n <= SIZE_STEP * own[0]]
            own = own[len(group) :]
            stretch = max(n + allowed_edits(n) for n in group)
            out.setdefault(words, []).append((stretch, min(map(least_pairs, group))))
    return out


def _block(items: list[tuple]) -> Block | None:
    """Keys at every offset of every item; documents need only a grid of windows."""
    texts = pa.array([text for _, text in items], pa.string())
    powers = None
    words: list[np.ndarray] = []
    for _, _, raw, where in text_blocks(texts, lower=True):
        powers = (_powers(_BASE, len(raw) + 1), _powers(_BACK, len(raw) + 1))
        hashes, cuts = word_hashes(raw, where, powers)
        words += [hashes[a:b] for a, b in zip(cuts, cuts[1:])]
    kept = [i for i, own in enumerate(words) if len(own) >= MIN_WORDS]
    if not kept:
        return None
    ids, words = [items[i][0] for i in kept], [words[i] for i in kept]
    sizes = [len(own) for own in words]
    layers = layers_for([n for n in sizes if n >= EXACT_WORDS])
    keys, owners, offsets = [], [], []
    for layer in layers:
        for i, own in enumerate(words):
            if len(own) >= EXACT_WORDS and window_words(len(own)) == layer.words:
                starts = np.arange(len(own) - layer.words + 1)
                found = keys_of(np.r_[own, np.full(layer.words, _PAD)], starts, layer)
                keys.append(found.reshape(-1))
                owners.append(np.full(found.size, i, np.int32))
                offsets.append(np.tile(starts, len(found)).astype(np.int32))
    for i, own in enumerate(words):  # short items: the first pair is the key
        if len(own) < EXACT_WORDS:
            keys.append(pair_hashes(own[:2]))
            owners.append(np.full(1, i, np.int32))
            offsets.append(np.zeros(1, np.int32))
    keys, owners, offsets = np.concatenate(keys), np.concatenate(owners), np.concatenate(offsets)
    order = np.argsort(keys, kind="stable")
    pairs = np.unique(np.concatenate([pair_hashes(own) for own in words]))
    bounds = size_bounds([n for n in sizes if n >= EXACT_WORDS])
    return Block(ids, words, layers, keys[order], owners[order], offsets[order], pairs, bounds)


def item_blocks(benchmark: DataFrame, block_keys: int = BLOCK_KEYS):
    """Blocks of items of bounded size, one at a time on the driver.

    Equal texts are one item, under their smallest id.
    """
    items = benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    # a key per word and table, of which there are at most four walks' worth as a rule
    load = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    count = max(1, ceil(load * 4 * TABLES_PER_WALK / block_keys))
    for n in range(count):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == n) if count > 1 else items
        found = _block(sorted((tuple(r) for r in own.select("item_id", "text").collect()), key=repr))
        if found:
            yield found


class Table:
    """Sorted keys behind a bit table, which most absent keys do not pass."""

    def __init__(self, keys: np.ndarray):
        width = max(16, len(keys).bit_length() + FILTER_BITS)
        self.keys, self.shift = keys, np.uint64(64 - width)
        self.bits = np.zeros(1 << width - 3, np.uint8)
        slots = keys >> self.shift
        np.bitwise_or.at(self.bits, slots >> np.uint64(3), np.left_shift(np.uint8(1), (slots & np.uint64(7)).astype(np.uint8)))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` that pass the bit table."""
        slot = keys >> self.shift
        return np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        hit = self.may_hold(keys)
        place = np.minimum(np.searchsorted(self.keys, keys[hit]), max(0, len(self.keys) - 1))
        out[hit] = self.keys[place] == keys[hit] if len(self.keys) else False
        return out


def reachable(known: np.ndarray, cuts: np.ndarray, stretch: int, least: int) -> np.ndarray:
    """True for the words of texts that lie in a stretch of ``stretch`` words of
    one text with at least ``least`` known pairs. ``known[i]`` tells whether word i
    and the next are a pair of an item."""
    n = len(known)
    sums = np.r_[0, np.cumsum(known)]
    sizes = np.diff(cuts)
    begin = np.arange(n)
    end = np.minimum(begin + stretch, np.repeat(cuts[1:], sizes))
    # a text that is shorter than the stretch is one stretch from its first word
    good = sums[np.maximum(end - 1, begin)] - sums[begin] >= least
    opened, closed = np.bincount(begin[good], minlength=n + 1), np.bincount(end[good], minlength=n + 1)
    return np.cumsum(opened - closed)[:-1] > 0


def _search(hashes: np.ndarray, cuts: np.ndarray, block: Block, table: Table, pairs: Table | None):
    """Verified matches as (text, item, distance, first word, end word).

    Without ``pairs`` every window is embedded and every candidate verified; the
    answer is the same.
    """
    met = []  # (text, item, first word of the item if nothing was inserted)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    sizes = np.diff(cuts)
    padded = np.r_[hashes, np.full(max([2, *(layer.words for layer in block.layers)]), _PAD)]
    own_pairs = pair_hashes(padded[: len(hashes) + 1])
    known = pairs.holds(own_pairs) if pairs else np.ones(len(hashes), bool)
    ends = cuts[1:][sizes > 0] - 1
    known[ends] = False  # the last word of a text has no next
    sums = np.r_[0, np.cumsum(known)]

    def meet(keys: np.ndarray, starts: np.ndarray, text: np.ndarray) -> None:
        hit = table.may_hold(keys)
        low = np.searchsorted(block.keys, keys[hit], "left")
        n = np.searchsorted(block.keys, keys[hit], "right") - low
        window = np.repeat(hit, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        if len(entry):
            met.append(np.unique(np.column_stack([text[window], block.owners[entry], starts[window] - block.offsets[entry]]), axis=0))

    for layer in block.layers:
        counts = np.maximum(0, (sizes - layer.words) // layer.stride + 1)
        counts[sizes < layer.words] = 0
        total = int(counts.sum())
        text = np.repeat(np.arange(len(sizes)), counts)
        number = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = cuts[text] + number * layer.stride
        if pairs:
            reached = np.zeros(len(hashes), bool)
            for stretch, least in block.bounds[layer.words]:
                reached |= reachable(known, cuts, stretch, least)
            chosen = reached[starts]
            starts, text = starts[chosen], text[chosen]
        for at in range(0, len(starts), 200_000):
            for keys in keys_of(padded, starts[at : at + 200_000], layer):
                meet(keys, starts[at : at + 200_000], text[at : at + 200_000])
    if min(map(len, block.words)) < EXACT_WORDS:
        first = np.flatnonzero(known)
        meet(own_pairs[first], first, np.searchsorted(cuts, first, "right") - 1)
    found = np.unique(np.concatenate(met), axis=0) if met else np.zeros((0, 3), np.int64)
    lengths = np.array([len(own) for own in block.words])
    slacks = np.array([allowed_edits(n) for n in lengths])
    if pairs and len(found):
        doc, item, begin = found.T
        # begins up to the slack apart are verified together, in a region that lies in here
        low = np.maximum(cuts[doc], begin - 2 * slacks[item])
        high = np.minimum(cuts[doc + 1], begin + lengths[item] + 2 * slacks[item])
        found = found[sums[np.maximum(high - 1, low)] - sums[low] >= lengths[item] - 1 - 2 * slacks[item]]
    groups: list[tuple[int, int, int, int]] = []  # begins up to the slack apart are verified at once
    for doc, item, begin in found.tolist():
        if groups and groups[-1][:2] == (doc, item) and begin <= groups[-1][2] + slacks[item]:
            groups[-1] = (*groups[-1][:3], begin)
        else:
            groups.append((doc, item, begin, begin))
    counts_of = {item: Counter(block.words[item].tolist()) for _, item, _, _ in groups}
    for doc, item, begin, last in groups:
        own = block.words[item]
        slack = int(slacks[item])
        first = max(int(cuts[doc]), begin - slack)
        region = hashes[first : min(int(cuts[doc + 1]), last + len(own) + slack)]
        # an item within the slack shares that many words at least, repeats included
        near = region.tolist()
        if sum(map(counts_of[item].__contains__, near)) < len(own) - slack:
            continue
        if (counts_of[item] & Counter(near)).total() < len(own) - slack:
            continue
        ends = edit_ends(own, region)
        end = int(ends.argmin())
        distance = int(ends[end])
        if distance <= slack and distance < best.get((doc, item), (1 << 30,))[0]:
            back = edit_ends(own[::-1], region[:end][::-1])
            start = end - int(back.argmin())
            best[doc, item] = (distance, first + start - int(cuts[doc]), first + end - int(cuts[doc]))
    return sorted((doc, item, *found) for (doc, item), found in best.items())


def find(docs: DataFrame, benchmark: DataFrame, name: str = "items") -> DataFrame:
    """``docs`` with the benchmark items that each text holds.

    ``name`` is an array of (item_id, distance, similarity, first_word, end_word):
    the best stretch of the text for each item with at most 20 % word edits; equal
    items come under their smallest id. Items of fewer than EXACT_WORDS words allow
    no edit at that rate. Windows lie on a grid in the documents and
    at every offset in the items. Null, empty and short texts hold none; null and
    empty items, and those below MIN_WORDS words, match nothing. All columns are
    passed on, ``name`` must be new.
    """
    if name in docs.columns:
        raise ValueError(f"column {name!r} exists")
    at = docs.columns.index("text")
    key = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"array<struct<item_id: {key}, distance: int, similarity: double, first_word: int, end_word: int>>"

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def searched(block: Block, input_: DataFrame, output: str) -> DataFrame:
        def run(batches):
            table, pairs = Table(block.keys), Table(block.pairs)
            powers = (_powers(_BASE, 1), _powers(_BACK, 1))
            for batch in batches:
                rows: list[list] = [[] for _ in range(len(batch))]
                for first, _, raw, where in text_blocks(batch.column(at), lower=True):
                    if len(powers[0]) <= len(raw):
                        powers = (_powers(_BASE, len(raw) + 1), _powers(_BACK, len(raw) + 1))
                    hashes, cuts = word_hashes(raw, where, powers)
                    if not len(hashes):
                        continue
                    for doc, item, distance, start, end in _search(hashes, cuts, block, table, pairs):
                        rows[first + doc].append(
                            {
                                "item_id": block.ids[item],
                                "distance": distance,
                                "similarity": 1 - distance / len(block.words[item]),
                                "first_word": start,
                                "end_word": end,
                            }
                        )
                kind = pa.struct(
                    [("item_id", item_type), ("distance", pa.int32()), ("similarity", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rows, pa.list_(kind))], [*batch.schema.names, output]
                )

        return map_arrow(input_, run, fields_of(input_) + f", `{output}` {schema}")

    out, parts = docs, []
    for n, block in enumerate(item_blocks(benchmark)):
        parts.append(f"_{name}_{n}")
        out = searched(block, out, parts[-1])
    found = F.concat(*parts) if parts else F.array().cast(schema)
    return out.withColumn(name, found).drop(*parts)
