"""Fill-in-middle examples by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable
buffers: its own text and the sentinels. Cutting splits descriptors, a form puts
the parts in another order between sentinels, the inverse order restores the
text, and hashes read the descriptors one after the other. Bytes are copied only
where an output is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelspark.llm.common import fields_of, map_arrow, text_blocks

SEED = 42
FIM_PERCENT = 50  # documents that are cut at all
SPM_PERCENT = 80  # of those, in suffix-prefix-middle order
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# The second buffer holds the sentinels one after the other.
SENTINELS = PREFIX + SUFFIX + MIDDLE
# Each form: sentinel and part (0 prefix, 1 middle, 2 suffix) in the order of the output.
FORMS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
TEXT, ADDED = 0, 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class PieceTable:
    """Descriptors (buffer, start, length); the buffers never change."""

    def __init__(self, text: memoryview, pieces: list[tuple[int, int, int]] | None = None):
        self.buffers = (text, memoryview(SENTINELS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, offsets: list[int]) -> PieceTable:
        """Split so that a descriptor ends at each offset (ascending). Two equal
        offsets leave an empty descriptor between them."""
        out, begin, left = [], 0, list(offsets)
        for buffer, start, length in self.pieces:
            at = 0
            while left and left[0] <= begin + length:
                to = left.pop(0) - begin
                out.append((buffer, start + at, to - at))
                at = to
            out.append((buffer, start + at, length - at))
            begin += length
        return PieceTable(self.buffers[TEXT], out)

    def arranged(self, form: str) -> PieceTable:
        """Three descriptors in the order of a form, a sentinel before each."""
        out = []
        for sentinel, part in FORMS[form]:
            out += [(ADDED, SENTINELS.index(sentinel), len(sentinel)), self.pieces[part]]
        return PieceTable(self.buffers[TEXT], out)

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: the parts without sentinels, in text order."""
        parts = [p for p in self.pieces if p[0] == TEXT]
        back = np.argsort([part for _, part in FORMS[form]])
        return PieceTable(self.buffers[TEXT], [parts[i] for i in back])

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            if length:
                yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        found = hashlib.sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()


def read_output(output: bytes, form: str) -> PieceTable:
    """An output as descriptors over itself, sentinels as those of the added buffer.

    The text of a cut document holds no sentinel, and a sentinel has its only
    ``<`` in front, so none can arise where text and sentinel meet: the first
    place of each is the right one.
    """
    pieces, at = [], 0
    order = FORMS[form]
    for place, (sentinel, _) in enumerate(order):
        if output[at : at + len(sentinel)] != sentinel:
            raise ValueError(f"no output of the form {form!r}")
        at += len(sentinel)
        end = output.find(order[place + 1][0], at) if place + 1 < len(order) else len(output)
        if end < 0:
            raise ValueError(f"no output of the form {form!r}")
        pieces += [(ADDED, SENTINELS.index(sentinel), len(sentinel)), (TEXT, at, end - at)]
        at = end
    return PieceTable(memoryview(output), pieces)


def restore(output: bytes, form: str) -> PieceTable:
    """The text that an output was made of."""
    if form == "plain":
        return PieceTable(memoryview(output))
    return read_output(output, form).restored(form)


def token_ends(raw: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of every token in ``raw``, token offsets of the texts).

    A token is a word with the blanks before it, or the blanks that end a text.
    """
    last = np.zeros(len(raw), bool)
    if len(raw):
        space = _SPACE[raw]
        last[:-1] = ~space[:-1] & space[1:]
        last[where[1:][where[1:] > where[:-1]] - 1] = True
        # a blank at a text's end closes a token, a word before it has closed its own
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, where, "right")


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the id; a null id counts as no digits."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def fill_in_middle(
    docs: DataFrame,
    name: str = "fim",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    with_output: bool = True,
) -> DataFrame:
    """``docs`` with a struct ``name`` of n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256 and, unless ``with_output`` is off, output.

    ``n`` counts the tokens of the whole text. ``form`` is plain, psm or spm; the
    first cut falls after the smaller of two draws from the id, the second after
    the larger. Characters are code points, null where the form is plain. The
    restored hash is that of the text read back from the output and its form.

    A null text counts as empty; an empty text and one that holds a sentinel stay
    as they are. A null id draws like an empty one, repeated rows come out alike.
    An empty table gives an empty one. All columns are passed on, ``name`` must
    be new. Each text is handled in the task that reads it, by its bytes; there is
    no shuffle.
    """
    if name in docs.columns:
        raise ValueError(f"column {name!r} exists")
    id_at, at = docs.columns.index("doc_id"), docs.columns.index("text")
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
              ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    kinds = "n: long, form: string, prefix_chars: long, middle_chars: long, output_sha256: string, restored_sha256: string"
    if with_output:
        fields.append(("output", pa.string()))
        kinds += ", output: string"

    def example(doc_id, raw: np.ndarray, ends: np.ndarray) -> tuple:
        text, n = raw.tobytes(), len(ends)
        h1, h2, h3, h4 = draws(doc_id, seed)
        table, form, sizes = PieceTable(memoryview(text)), "plain", (None, None)
        if text and h3 % 100 < fim_percent and not any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            form = "spm" if h4 % 100 < spm_percent else "psm"
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            cuts = [int(ends[i - 1]) if i else 0 for i in (first, second)]
            letters = (raw & 0xC0) != 0x80  # bytes that begin a code point
            sizes = (int(letters[: cuts[0]].sum()), int(letters[cuts[0] : cuts[1]].sum()))
            table = table.cut(cuts).arranged(form)
        output = b"".join(table.stream())
        row = (n, form, *sizes, table.sha256(), restore(output, form).sha256())
        return (*row, output) if with_output else row

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(id_at).to_pylist(), []
            for first, end, raw, where in text_blocks(batch.column(at)):
                ends, cuts = token_ends(raw, where)
                for i in range(end - first):
                    a, b = where[i], where[i + 1]
                    rows.append(example(ids[first + i], raw[a:b], ends[cuts[i] : cuts[i + 1]] - a))
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            arrays = [
                pa.array(c, pa.binary()).cast(k) if f == "output" else pa.array(c, k) for c, (f, k) in zip(columns, fields)
            ]
            found = pa.StructArray.from_arrays(arrays, names=[f for f, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return map_arrow(docs, run, fields_of(docs) + f", `{name}` struct<{kinds}>")


def restored(examples: DataFrame, output: str = "output", form: str = "form", name: str = "text") -> DataFrame:
    """``examples`` with the original text read back from output and form.

    A null output or form gives a null text. ``name`` must be new.
    """
    if name in examples.columns:
        raise ValueError(f"column {name!r} exists")
    at, form_at = examples.columns.index(output), examples.columns.index(form)

    def run(batches):
        for batch in batches:
            texts = [
                None if o is None or f is None else b"".join(restore(o.encode(), f).stream()).decode()
                for o, f in zip(batch.column(at).to_pylist(), batch.column(form_at).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return map_arrow(examples, run, fields_of(examples) + f", `{name}` string")

