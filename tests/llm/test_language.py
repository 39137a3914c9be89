import numpy as np
from pyspark.sql import functions as F

from labelspark.llm import language
from labelspark.llm.common import held_out


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 12, 40):
        code = language.codebook(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1, 1}
        assert (np.abs(code.sum(axis=0)) < n).all()
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs, ~out)
    rows = language.identify(docs.filter(out), model).collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_decoding_takes_the_nearest_codeword():
    code = language.codebook(4)
    model = language.Model(list("abcd"), code, np.zeros((code.shape[1], 1)), np.tile([1.0, 0.0], (code.shape[1], 1)))
    margins = code.astype(float) * 3
    margins[:, 0] *= -1  # one bit wrong everywhere
    best, share = language.decode(margins, model)
    assert best.tolist() == [0, 1, 2, 3] and (share > 0.5).all()
    tie, share = language.decode(np.zeros((1, code.shape[1])), model)
    assert tie.tolist() == [0] and share[0] < language.AMBIGUOUS


def test_edge_rows(spark, edge_docs, no_docs):
    model = language.fit(edge_docs, F.lit(True))
    rows = language.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und"
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"}
    none = language.fit(no_docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(edge_docs, none).collect()} == {"und"}
    one = language.fit(edge_docs, F.col("lang") == "en")
    assert {r.lang_pred for r in language.identify(edge_docs, one).collect()} == {"und", "en"}
    assert language.identify(no_docs, model).count() == 0
