"""From raw documents to packed training sequences, stage by stage.

Every stage works on all that the one before it kept, and all but the last
return the columns of documents. Learned stages are fitted on labelled documents
of their own input, without those that op2_toxicity and op5_quality hold out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import decontaminate, packing, quality, simhash, toxicity
from labelspark.llm.common import held_out
from labelspark.session import new_folder

TOKENIZER = "byte_bpe_50k.json"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose chance of being toxic is a half or more."""
    model = toxicity.fit(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 5, 0))
    name = _unused(docs, "_toxicity")
    return toxicity.score(docs, model, name, spans=None).filter(F.col(name) < 0.5).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose chance of being good is below a half."""
    model = quality.fit(docs, _labels(spark, sf_dir), ~held_out(F.col("doc_id"), 3, 1))
    name = _unused(docs, "_quality")
    return quality.score(docs, model, name).filter(F.col(name) >= 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: fingerprints of four-word
    shingles, linked at four or fewer differing bits.

    It is the one of smallest id, the first stored one where ids repeat or all of
    the component are null.
    """
    return simhash.one_of_each_group(docs, words=4, max_distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = _unused(docs, "_items")
    return decontaminate.find(docs, items, name).filter(F.size(name) == 0).drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents, with their token ids."""
    import public_tokenizers  # only this stage needs the vocabulary files

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# learned scores and a tokenizer have no SQL; tests hold the stages against brute force
ORACLE_SQL = None
