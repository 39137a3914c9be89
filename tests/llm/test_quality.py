import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from labelspark.llm import quality
from labelspark.llm.common import held_out, text_blocks


def test_chunks_cover_every_stride_of_every_text():
    texts = pa.array(["", "a", "x" * 509, "y" * 512, "z" * 513, "w" * 5000, None])
    for _, _, raw, where in text_blocks(texts):
        padded, starts = quality.padded(raw, where)
        first, end, text = quality.chunk_spans(starts)
        for t in range(len(where) - 1):
            covered = np.zeros(starts[t + 1] - starts[t], bool)
            for a, b in zip(first[text == t], end[text == t]):
                assert starts[t] <= a < b < starts[t + 1]
                covered[a - starts[t] : b + 1 - starts[t]] = True
            assert covered.all()
            assert bytes(padded[starts[t] * 4 : starts[t + 1] * 4]).rstrip(b"\0") == raw[where[t] : where[t + 1]].tobytes()


def test_block_scores_equal_text_scores():
    rng = np.random.default_rng(1)
    chunks = rng.integers(97, 120, (64, 512)).astype(np.uint8)
    model = quality.train(chunks, (np.arange(64) % 2).astype(np.float32))
    texts = ["abc" * 7, "", "qrs" * 900, "t" * 511]
    whole = [quality.text_features(raw, where, model) for _, _, raw, where in text_blocks(pa.array(texts))]
    single = [quality.text_features(raw, where, model) for t in texts for _, _, raw, where in text_blocks(pa.array([t]))]
    assert np.allclose(np.concatenate(whole), np.concatenate(single), atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")  # only labelled rows count below
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, labels, ~out)
    scored = quality.score(docs, model, "chance").join(labels, "doc_id").filter(out)
    n, right = scored.agg(F.count("*"), F.sum(((F.col("chance") >= 0.5).cast("int") == F.col("quality")).cast("int"))).first()
    assert n > 1000 and right / n > 0.96


def test_edge_rows(spark, edge_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(100, 140)] + [(None, 1, 1), (1, None, 1)], no_labels.schema)
    for given in (labels, no_labels):
        model = quality.fit(edge_docs, given, F.lit(True))
        rows = quality.score(edge_docs, model).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.quality <= 1 for r in rows)
        assert quality.score(no_docs, model).count() == 0
    assert quality.fit(no_docs, labels, F.lit(True)) == 0.5
