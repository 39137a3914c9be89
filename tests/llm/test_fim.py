"""Fill-in-middle examples against a plain restatement over code points."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from labelspark.llm import fim

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_example(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by joining strings."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["<P> in it", "a <S", "<S <M <P", "end<", " \t lead", "trail \n ", "\x0b\x0c", "é ü ñ 😀 x", "a b c", "one", " ", "x" * 70_000 + " y"]


@pytest.fixture
def documents(spark, edge_rows):
    rows = [(r[0], r[1], 1, "x") for r in edge_rows] + [(1000 + 20 * i + j, t, 2, "y") for i, t in enumerate(ODD) for j in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n int, form string").repartition(3)


def test_equals_the_plain_version(documents):
    rows, docs = documents
    got = sorted(((r.doc_id, r.text, r.n, r.form, *r.fim) for r in fim.fill_in_middle(docs).collect()), key=repr)
    want = []
    for doc_id, text, *others in rows:
        *head, output = plain_example(doc_id, text)
        want.append((doc_id, text, *others, *head, sha(output), sha(text or ""), output))
    assert got == sorted(want, key=repr)
    assert {r[5] for r in want} == {"plain", "psm", "spm"}


def test_outputs_are_read_back(documents):
    _, docs = documents
    made = fim.fill_in_middle(docs).select("doc_id", "text", F.col("fim.form").alias("f"), F.col("fim.output").alias("o"))
    back = fim.restored(made, "o", "f", "again").select(F.coalesce("text", F.lit("")).eqNullSafe(F.col("again")).alias("same"))
    assert back.filter("not same").count() == 0 and back.count() == docs.count()


def test_cutting_and_arranging_pieces():
    text = b"one two  three"
    table = fim.PieceTable(memoryview(text)).cut([3, 3, 9])
    assert table.pieces == [(0, 0, 3), (0, 3, 0), (0, 3, 6), (0, 9, 5)]
    assert table.cut([0, 4]).pieces == [(0, 0, 0), (0, 0, 3), (0, 3, 0), (0, 3, 1), (0, 4, 5), (0, 9, 5)]
    parts = fim.PieceTable(memoryview(text)).cut([3, 7])
    for form in fim.FORMS:
        arranged = parts.arranged(form)
        assert arranged.restored(form).pieces == parts.pieces
        output = b"".join(arranged.stream())
        assert arranged.sha256() == hashlib.sha256(output).hexdigest()
        assert b"".join(fim.restore(output, form).stream()) == text
    with pytest.raises(ValueError):
        fim.read_output(b"<P>a<M>b", "psm")


def test_shares_can_be_set(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    count = lambda **k: {r[0]: r[1] for r in fim.fill_in_middle(docs, **k).groupBy("fim.form").count().collect()}
    assert count(fim_percent=0) == {"plain": 400} and count(fim_percent=100, spm_percent=0) == {"psm": 400}
    assert 120 < count()["plain"] < 280 and count(seed=1) != count()


def test_no_rows_and_taken_names(no_docs):
    assert fim.fill_in_middle(no_docs).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(no_docs, "label")
