"""Hierarchical packing of tokenised documents into sequences of several sizes.

Whole windows of a document become sequences as they are. Its rest is routed to
the smallest context size that holds it. Longer windows are filled with the
largest shorter rests that fit, the last gap with a cut one; what is left of the
shorter tiers fills windows of their own size. Sequences of one size are dealt
into step groups of equal token counts.
"""

from __future__ import annotations

import os
import re
import sys
from bisect import bisect_right, insort
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from labelspark.llm.common import map_arrow

TIERS = (128, 256, 512, 1024)
END_ID = 0
GROUP_TOKENS = 65_536  # tokens of one step group
POOL = 2_048  # rests that a task holds before it packs them
MEMO_WORDS = 400_000  # pre-tokens a worker remembers before it starts anew
EMIT_TOKENS = 500_000

# Byte-level BPE splits a text first and encodes each part alone. Parts are found here
# for texts of ASCII and Latin letters; any other text goes to the tokenizer whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_JOINED = 256  # parts that are encoded in one string
_BETWEEN = "\0"
_PLAIN_BYTES = [0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0x100)]  # of the texts that are split here
BLOCK_CHARS = 500_000  # characters of the texts that are split together


def part_starts(raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin, for the rules of the vocabulary's own splitter.

    A part is a run of letters, of digits or of other marks, with one blank space
    before it; an apostrophe that begins a run stands with s, t, m, d, re, ve or ll
    after it; other white space is one part, but for its last character where a
    text goes on. Parts cover the texts without gaps.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[raw]
    begins = np.zeros(n + 1, bool)
    begins[where[:-1][where[1:] > where[:-1]]] = True
    text_start = begins.copy()
    text_start[n] = True
    begins[1:n] |= kind[1:] != kind[:-1]
    begins[n] = True
    runs = np.flatnonzero(begins)
    start, end = runs[:-1], runs[1:]
    marked = begins[:n].copy()
    # the last blank before a run: a space joins it, another one stands alone
    before = (kind[start] == _BLANK) & ~text_start[end]
    last, follow = end[before] - 1, end[before]
    marked[last] = True
    marked[follow[raw[last] == 0x20]] = False
    # apostrophes: alone in their run, first in their part, letters after them
    quote = (raw[start] == 0x27) & (end - start == 1) & ~text_start[end] & marked[start]
    at = start[quote]
    at = at[kind[at + 1] == _LETTER]
    if len(at):
        stop = runs[np.searchsorted(runs, at + 1, "right")]
        one, two = raw[at + 1], raw[np.minimum(at + 2, n - 1)]
        size = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
        pair = (stop - at > 2) & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        size[pair] = 2
        at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
        marked[at + 1] = False
        rest = at + 1 + size
        marked[rest[rest < stop]] = True
    return np.flatnonzero(marked)


class _Memo(dict):
    """Word → number; a new word gets the next number and is queued."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.queue.append(word)
        return number


class Encoder:
    """Token ids by a ``tokenizers`` file, with a bounded memory of pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a token of a byte-level vocabulary has one character a byte
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        # the same model for parts that are found already: bytes as its own letters,
        # parts told apart by a character that is none of them
        self.parts = Tokenizer.from_file(path)
        self.parts.pre_tokenizer = CharDelimiterSplit(_BETWEEN)
        letters = {byte: byte_letter(byte) for byte in _PLAIN_BYTES}
        self.letters = str.maketrans({chr(byte): letter for byte, letter in letters.items()})
        self.reset()

    def reset(self) -> None:
        self.memo = _Memo()
        self.pool = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the queued parts, many in one call; their tokens are told apart by
        their bytes."""
        queue, self.memo.queue = self.memo.queue, []
        joined = [
            _BETWEEN.join(queue[i : i + _JOINED]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(queue), _JOINED)
        ]
        found = self.parts.encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.array(o.ids, np.uint32) for o in found])
        ends = np.cumsum([len(w.encode()) for w in queue], dtype=np.int64)
        upto = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(upto, ends, "right")
        if (upto[last - 1] != ends).any():
            raise ValueError("the vocabulary does not encode part by part")
        begin = np.r_[0, last[:-1]]
        self.starts = np.concatenate([self.starts, len(self.pool) + begin])
        self.sizes = np.concatenate([self.sizes, last - begin])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Distinct parts of all of them are looked up once."""
        if len(self.memo) > MEMO_WORDS:
            self.reset()
        whole = [bool(_OTHER.search(t)) or any(s in t for s in self.special) for t in texts]
        parts = [t.encode() for t, w in zip(texts, whole) if not w]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        where = np.cumsum([0, *map(len, parts)])
        begin = part_starts(raw, where)
        offsets = np.append(begin, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        words = pieces.dictionary.to_pylist()
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if self.memo.queue:
            self.learn()
        used = number[pieces.indices.to_numpy()]
        starts, sizes = self.starts[used], self.sizes[used]
        ends = np.cumsum(sizes)
        ids = self.pool[np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)]
        cuts = np.r_[0, ends][np.searchsorted(begin, where)].tolist()
        plain = iter(ids[a:b] for a, b in zip(cuts, cuts[1:]))
        direct = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
        return [np.array(next(direct).ids, np.uint32) if w else next(plain) for w in whole]


def text_runs(texts: list) -> list[tuple[int, int]]:
    """(first, end) of runs of texts of about BLOCK_CHARS characters, 256 at most."""
    runs, first, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= BLOCK_CHARS or i + 1 - first == 256:
            runs.append((first, i + 1))
            first, held = i + 1, 0
    return runs + [(first, len(texts))] if first < len(texts) else runs


def byte_letter(byte: int) -> str:
    """The character by which a byte-level vocabulary writes a byte: printable bytes
    stand for themselves, the others follow from 256 on in their order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(byte) if byte in own else chr(256 + [b for b in range(256) if b not in own].index(byte))


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder. Workers outlive tasks, so the parts that one task
    met need not be encoded again by the next; MEMO_WORDS bounds what is kept.

    This module's code comes with every task, so what is to stay is held by a
    module of the worker's own.
    """
    state = sys.modules.setdefault("_labelspark_worker", ModuleType("_labelspark_worker"))
    held = state.__dict__.setdefault("encoders", {})
    if path not in held:
        held.clear()
        held[path] = Encoder(path)
    return held[path]


class Packer:
    """Rests of documents → sequences. A rest is (length, number, doc, start)."""

    def __init__(self, tiers=TIERS, pool: int = POOL):
        self.tiers, self.limit = tiers, pool
        self.rests: list[tuple] = []
        self.number = 0

    def add(self, doc, start: int, length: int) -> None:
        self.number += 1
        self.rests.append((length, self.number, doc, start))

    def _cut(self, rest: tuple, take: int) -> tuple[tuple, tuple]:
        length, _, doc, start = rest
        self.number += 2
        return (take, self.number - 1, doc, start), (length - take, self.number, doc, start + take)

    def pack(self, last: bool = False):
        """Yield full windows as lists of rests. What fills no window waits; where
        that is over half of what may be held, as with rests that are all longer
        than half a window, it is cut into windows of the largest tier but for
        less than one. With ``last`` all is cut, the end into powers of two."""
        waiting: list[tuple] = []
        pool = sorted(self.rests)  # by length
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0]):
            opened = bisect_right(pool, (below, float("inf")))
            heads, pool = pool[opened:], pool[:opened]
            for head in reversed(heads):
                window, gap = [head], tier - head[0]
                while gap and pool:
                    fits = bisect_right(pool, (gap, float("inf")))
                    if fits:
                        rest = pool.pop(fits - 1)
                    else:
                        rest, left = self._cut(pool.pop(), gap)
                        insort(pool, left)
                    window.append(rest)
                    gap -= rest[0]
                if gap:
                    waiting += window
                else:
                    yield window
        self.rests = waiting
        if last or 2 * len(waiting) > self.limit:
            yield from self._filled(1 if last else self.tiers[-1])

    def _filled(self, least: int):
        """Windows of the largest tier, then of powers of two down to ``least``."""
        rests = sorted(self.rests)  # the longest is the next
        total = sum(r[0] for r in rests)
        while total >= least:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                rest = rests.pop()
                if rest[0] > gap:
                    rest, left = self._cut(rest, gap)
                    rests.append(left)
                window.append(rest)
                gap -= rest[0]
            total -= size
            yield window
        self.rests = rests


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    ``tiers`` are powers of two; ``tokenizer`` is the path of a ``tokenizers``
    file that executors can read. Every document ends with ``end_id``, a null or
    empty one has only that. No sequence is padded: each fills a tier, or, at the
    end of a task, a smaller power of two. Repeated rows and null ids are packed
    like others; other columns are not read. Each task packs its own partition
    in one pass and holds about POOL rests at most, so the result depends on how the
    input is split; a scan is split alike when a task is run again. The last step
    group of a task and tier is shorter than the others.
    """
    size = tiers[-1]
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")

    def run(batches):
        encoder, packer = encoder_of(tokenizer), Packer(tiers)
        base, counts = TaskContext.get().partitionId() << 33, {}
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
        rows: list[tuple] = []
        held, kind, sequences = 0, pa.int64(), 0

        def emit(window):
            nonlocal sequences, held
            total = sum(r[0] for r in window)
            tier = next(t for t in tiers if t >= total)
            place = counts[tier] = counts.get(tier, -1) + 1
            group = base + (tiers.index(tier) << 28) + place * tier // GROUP_TOKENS
            offset = 0
            for length, _, (doc_id, ids), start in window:
                piece = ids[start : start + length].tobytes()
                rows.append((doc_id, start, length, piece, len(ids), base + sequences, offset, tier, group))
                offset += length
            sequences += 1
            held += total

        def flush():
            nonlocal rows, held
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            ids_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in text_runs(texts):
                for doc_id, ids in zip(ids_[at:to], encoder.encode([t or "" for t in texts[at:to]])):
                    doc = (doc_id, np.append(ids, np.uint32(end_id)))
                    whole = len(doc[1]) // size * size
                    for start in range(0, whole, size):
                        emit([(size, 0, doc, start)])
                    if whole < len(doc[1]):
                        packer.add(doc, whole, len(doc[1]) - whole)
                    if held >= EMIT_TOKENS:
                        yield flush()
                if len(packer.rests) >= packer.limit:
                    for window in packer.pack():
                        emit(window)
                    yield flush()
        for window in packer.pack(last=True):
            emit(window)
        yield flush()

    key = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long",
    )
