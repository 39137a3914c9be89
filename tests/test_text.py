import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelspark.functions import text as T

# The expected rules, applied with another engine's regular expressions.
ALPHABET = "aB9_éè́œæ’‘`´–—-'/(),.:;!?  \n\t  ​😀ßﬁ²"


def py_clean(s):
    for pattern, replacement in [
        ("[´′’ʼ‘ʻ`]", "'"), ("[−‐–—]", "-"), ("æ", "ae"), ("œ", "oe"), (r"\s*'\s*", "'"),
        (r"\s+([,.])", r"\1"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"\s*/\s*", "/"),
    ]:
        s = re.sub(pattern, replacement, s)
    return s


def py_features(s):
    s = unicodedata.normalize("NFKD", s.lower())
    for pattern, replacement in [
        ("[´′’ʼ‘ʻ`]", "'"), ("[−‐–—]", "-"), (r"\s*'\s*", "' "), (r"\s*([,.:;!?])", r" \1"),
        (r"\s*([-/])\s*", r" \1 "), (r"\(\s*", "( "), (r"\s*\)", " )"), ("æ", "ae"), ("œ", "oe"), (r"\s+", " "),
    ]:
        s = re.sub(pattern, replacement, s)
    return s.strip()


def py_bag(s):
    s = unicodedata.normalize("NFKC", s.lower())
    blanked = {ord(c): " " for c in set(s) - {"'"} if unicodedata.category(c).startswith(("M", "S", "P"))}
    s = s.translate(blanked)
    s = re.sub(r"\s*'\s*", "' ", s).replace("æ", "ae").replace("œ", "oe")
    return re.sub(r"\s+", " ", s).strip()


def applied(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[1] for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(ALPHABET, max_size=40), min_size=200, max_size=300))
def test_normal_forms_equal_python(spark, values):
    assert applied(spark, values, T.clean_text) == [py_clean(v) for v in values]
    assert applied(spark, values, T.normalize_features) == [py_features(v) for v in values]
    assert applied(spark, values, T.normalize_bag) == [py_bag(v) for v in values]
    words = re.compile(r"(?u)\b\w\w+\b")
    assert applied(spark, values, T.word_tokens) == [words.findall(v) for v in values]
    assert applied(spark, values, T.num_words) == [len(v.split()) for v in values]
    assert applied(spark, values, T.strip) == [v.strip() for v in values]


def test_examples(spark):
    assert applied(spark, ["l ’ eau / gaz ( x ) , fin .", "œdème d'æ"], T.clean_text) == ["l'eau/gaz (x), fin.", "oedème d'ae"]
    # decomposed accents split words, composed ones do not
    assert applied(spark, ["préliminaire"], lambda c: T.analyze(c)) == [["pre", "liminaire"]]
    assert applied(spark, ["préliminaire"], lambda c: T.analyze(c, T.normalize_bag)) == [["préliminaire"]]
    assert applied(spark, [None], T.clean_text) == [None]


def test_stopwords_and_stem(spark):
    stop = T.default_stopwords("french")
    assert "le" in stop
    out = applied(spark, ["le chat les chats"], lambda c: T.analyze(c, T.normalize_bag, stop, lambda w: F.regexp_replace(w, "s$", "")))
    assert out == [["chat", "chat"]]


FENCE = "```"


@pytest.mark.parametrize(
    "answer, labels",
    [
        ("### Analysis\nwhy\n### Result\nA00, B01", ["A00", "B01"]),
        (f"{FENCE}\n## analysis and code assignment\nx\n### RESULT\nA00,B01\n{FENCE}", ["A00", "B01"]),
        (f"### Analysis\nx\n### Result\nA00\n{FENCE}\n", ["A00"]),
        (f"### Analysis\nx\n### Result\nA00\n{FENCE} ", [f"A00\n{FENCE}"]),
        ("### Analysis\nx\n### Result\n0", []),
        ("### Analysis\nx\n### Result\nA00 , B01,", ["A00 ", "B01"]),
        ("### Result\nA00", None),
        ("### Analysis\n### Analysis\n### Result\nA00", None),
        ("nothing", None),
    ],
)
def test_answers(spark, answer, labels):
    assert applied(spark, [answer], lambda c: T.answer_labels(T.answer_sections(c))) == [labels]


def test_template(spark):
    got = applied(spark, ["{x}"], lambda c: T.fill_template("a {{b}} {input_text}!", input_text=c))
    assert got == ["a {b} {x}!"]
    with pytest.raises(KeyError):
        T.fill_template("{gone}", input_text=F.lit(""))


def test_lines(spark, table):
    df = table([(["A", "B"], "le chat"), ([], "x")], "labels array<string>, text string")
    line = T.labelled_line(F.col("labels"), F.col("text"))
    got = {r[0]: (r[1], r[2]) for r in df.select(line, T.line_labels(line), T.line_text(line)).collect()}
    assert got["__label__A __label__B le chat"] == (["__label__A", "__label__B"], "le chat")
    assert got[" x"] == ([], " x")


def test_paths_and_names(spark):
    assert applied(spark, ["/d/My-set_b.test.jsonl"], T.split_name) == ["My.set.b.test"]
    assert applied(spark, ["Med-Line"], T.slug) == ["med_line"]
    assert applied(spark, ["a", "b"], lambda c: T.map_names(c, {"a": "x"})) == ["x", None]
    assert applied(spark, ["a\nb"], T.remove_newlines) == ["ab"]


def test_tags(spark, table):
    names = ["O", "B-DISO", "I-CHEM"]
    df = table([([0, 1],), ([0, 2],), ([],)], "t array<int>")
    got = sorted((r[0], r[1]) for r in df.select("t", T.any_tag_contains(F.col("t"), names)).collect())
    assert got == [([], False), ([0, 1], True), ([0, 2], False)]


def test_unicode_forms_take_a_batch_in_small_parts(monkeypatch):
    import unicodedata

    import pyarrow as pa

    monkeypatch.setattr(T, "TEXTS_AT_ONCE", 2)
    texts = ["é ﬁ", None, "", "ｗide", "plain"]
    for form in ("NFKD", "NFKC"):
        got = T._normalized(pa.array(texts, pa.string()), form)
        assert got.to_pylist() == [t if t is None else unicodedata.normalize(form, t) for t in texts]
        assert T._normalized(pa.array([], pa.string()), form).to_pylist() == []
