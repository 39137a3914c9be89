"""Hash buckets of n-grams, counted where the n-grams are made.

The n-grams of a text are some twenty times its words. As rows they would be made,
hashed and counted one by one; here a worker takes some thousand texts' words at a
time, hashes the character n-grams of a word once for all its occurrences, and word runs
as stretches of the joined words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Words that are taken at one time; a row is never cut.
CHUNK_WORDS = 50_000
# Words whose buckets a task remembers.
KEPT_WORDS = 200_000
# Messages that are hashed side by side: their state stays in the cache.
PIECE = 4096
# Longest message of one MD5 block.
ONE_BLOCK = 55

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(np.sin(i + 1.0)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
# By 1 + bytes of a message that lie in a word, -1 where it ended before: what is kept, and the bit that ends it.
_KEEP = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_END = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _rounds(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """First word of the MD5 of one-block messages; None stands for zeros."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    mixed = np.empty(n, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        elif part == 1:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        elif part == 2:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        else:
            np.bitwise_not(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        np.add(a, mixed, out=a)
        np.add(a, _SINES[i], out=a)
        if words[_PLACES[i]] is not None:
            np.add(a, words[_PLACES[i]], out=a)
        turn = _TURNS[part][i % 4]
        np.left_shift(a, turn, out=mixed)
        np.right_shift(a, 32 - turn, out=a)
        np.bitwise_or(a, mixed, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0])


def md5_heads(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of stretches of bytes."""
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        out[i] = int.from_bytes(hashlib.md5(data[starts[i] : starts[i] + sizes[i]], usedforsecurity=False).digest()[:4], "big")
    short = np.flatnonzero(sizes <= ONE_BLOCK)
    # stretches of like length side by side: most words of a block are all bytes or all zero
    short = short[np.argsort(sizes[short].astype(np.uint8), kind="stable")]
    wide = np.r_[data, np.zeros(64, np.uint8)].astype(np.uint32)
    at_byte = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    for first in range(0, len(short), PIECE):
        own = short[first : first + PIECE]
        begin, size = starts[own], sizes[own]
        least, most = int(size[0]), int(size[-1])
        words: list[np.ndarray | None] = [None] * 16
        for j in range(most // 4 + 1):
            word = at_byte[begin + 4 * j]
            if least < 4 * j + 4:
                inside = np.clip(size - 4 * j, -1, 4) + 1
                word = word & _KEEP[inside] | _END[inside]
            words[j] = word
        words[14] = (size * 8).astype(np.uint32)
        out[own] = _rounds(words, len(own)).byteswap()
    return out


class _Words:
    """Buckets of a word and of its character n-grams, by the word's number."""

    def __init__(self, buckets: int, low: int, high: int, chars: bool):
        self.buckets, self.sizes, self.chars = buckets, range(low, high + 1), chars
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) + len(words) > KEPT_WORDS:
            self.forget()
        new = [w for w in words if w not in self.number]
        if new:
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _learn(self, new: list[str]) -> None:
        known = len(self.number)
        self.number.update(zip(new, range(known, known + len(new))))
        data = np.frombuffer("".join(f"<{w}>" for w in new).encode(), np.uint8)
        letters = np.array([len(w) + 2 for w in new])
        points = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # bytes where code points begin
        end = np.cumsum(letters)
        first = end - letters
        starts, sizes = [points[first + 1]], [points[end - 1] - points[first + 1]]
        owner = [np.arange(len(new))]
        whole = np.array([" " not in w for w in new]) if self.chars else np.zeros(len(new), bool)
        for size in self.sizes:
            places = np.where(whole, np.maximum(letters - size + 1, 0), 0)
            of = np.repeat(np.arange(len(new)), places)
            at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(places) - places, places)
            starts.append(points[at])
            sizes.append(points[at + size] - points[at])
            owner.append(of)
        of = np.concatenate(owner)
        found = md5_heads(data, np.concatenate(starts), np.concatenate(sizes)).astype(np.int64) % self.buckets
        count = np.bincount(of, minlength=len(new))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
        self.count = np.r_[self.count, count]
        self.flat = np.r_[self.flat, found[np.argsort(of, kind="stable")]]


class _Merge:
    """Adds up what is counted under one bucket, without a sort."""

    def __init__(self, buckets: int):
        self.last = np.zeros(buckets, np.int64)

    def __call__(self, bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.arange(len(bucket))
        self.last[bucket] = place
        of = self.last[bucket]
        kept = np.flatnonzero(of == place)
        return bucket[kept], np.bincount(of, n, len(bucket))[kept].astype(np.int64)


def _runs(words: pa.Array, of: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the runs of 2..n words inside one row, rows in order; no run holds a null."""
    if n < 2 or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = words.is_valid().to_numpy(zero_copy_only=False)
    words = words.cast(pa.string()).fill_null("")
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(ends)
    begin = np.cumsum(size + 1) - (size + 1)
    data = np.full(int(size.sum()) + len(words), 32, np.uint8)
    letters = np.ones(len(data), bool)
    letters[begin + size] = False
    if ends[-1] > ends[0]:
        data[letters] = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts, sizes, rows = [], [], []
    held = known
    for k in range(1, n):
        held = held[:-1] & known[k:]
        first = np.flatnonzero(held & (of[:-k] == of[k:]))
        starts.append(begin[first])
        sizes.append(begin[first + k] + size[first + k] - begin[first])
        rows.append(of[first])
    row = np.concatenate(rows)
    found = md5_heads(data, np.concatenate(starts), np.concatenate(sizes)).astype(np.int64) % buckets
    order = np.argsort(row, kind="stable")
    return row[order], found[order]


def count_buckets(batches: Iterator[pa.RecordBatch], n: int, low: int, high: int, chars: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Batches (row id, words, place of the row among those of its id) in order of
    the id become batches (row id, bucket, n), a line for each bucket of an id."""
    learned, merge = _Words(buckets, low, high, chars), _Merge(buckets)
    held: tuple[pa.Array, np.ndarray, np.ndarray] | None = None  # the id that may go on: itself, buckets, counts

    def lines(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(found)), [len(b) for b, _ in found])
        columns = [np.concatenate([own[i] for own in found]) for i in range(2)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *map(pa.array, columns)], names=["id", "bucket", "n"])

    for batch in batches:
        lists, first = batch.column(1), 0
        at = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        while first < len(batch):
            end = min(max(int(np.searchsorted(at, at[first] + CHUNK_WORDS, side="right")) - 1, first + 1), len(batch))
            words = lists.slice(first, end - first).flatten()
            begins = batch.column(2).slice(first, end - first).to_numpy() == 1
            group = np.cumsum(begins)  # 0 goes on from before
            of = np.repeat(group, np.diff(at[first : end + 1]))
            # word runs never cross a row
            run_row, run_bucket = _runs(words, np.repeat(np.arange(end - first), np.diff(at[first : end + 1])), n, buckets)
            run_group = group[run_row]
            coded = words.dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = learned.numbers(coded.dictionary.to_pylist())
            pair, times = np.unique((of * max(len(number), 1) + code)[code >= 0], return_counts=True)
            pair_group, word = np.divmod(pair, max(len(number), 1))
            word = number[word]
            many = learned.count[word]
            place = np.repeat(learned.first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            word_bucket, word_n, word_group = learned.flat[place], np.repeat(times, many), np.repeat(pair_group, many)
            groups = np.arange(group[-1] + 2)
            runs_at, words_at = np.searchsorted(run_group, groups), np.searchsorted(word_group, groups)
            found = []
            for g in range(group[-1] + 1):
                runs, own = slice(runs_at[g], runs_at[g + 1]), slice(words_at[g], words_at[g + 1])
                found.append(merge(np.r_[run_bucket[runs], word_bucket[own]], np.r_[np.ones(runs.stop - runs.start, np.int64), word_n[own]]))
            ids = batch.column(0).slice(first, end - first).filter(pa.array(begins))
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                found[0] = merge(np.r_[held[1], found[0][0]], np.r_[held[2], found[0][1]])
            else:
                found = found[1:]
            if len(found) > 1:
                yield lines(ids[:-1], found[:-1])
            held = (ids[len(ids) - 1 :], *found[-1])
            first = end
    if held is not None:
        yield lines(held[0], [held[1:]])
