"""Fixed schemas of the record tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


GEN_CONFIGS = _struct(
    prompt=T.StringType(),
    temperature=T.DoubleType(),
    top_p=T.DoubleType(),
    repetition_penalty=T.DoubleType(),
    max_tokens=T.IntegerType(),
    model=T.StringType(),
)

TOKENISED = _struct(tokens=STRINGS, ner_tags=T.ArrayType(T.IntegerType()))
CORPUS = _struct(raw_text=T.StringType(), text=T.StringType(), has_diso=T.BooleanType())
GENERATED_LABELS = T.StructType(CORPUS.fields + _struct(output=T.StringType(), gen_configs=GEN_CONFIGS).fields)
LABELLED = _struct(text=T.StringType(), has_diso=T.BooleanType(), labels=STRINGS)
VERIFIED = T.StructType(LABELLED.fields + _struct(output=T.StringType(), gen_configs=GEN_CONFIGS).fields)
GENERATED_TEXT = _struct(labels=STRINGS, text=T.StringType(), gen_configs=GEN_CONFIGS)
CODE_DICTIONARY = _struct(code=T.StringType(), description=T.StringType())
CODE_FREQS = _struct(code=T.StringType(), freq=T.DoubleType())
PREDICTIONS = T.StructType(LABELLED.fields + _struct(pred_probs=T.ArrayType(T.DoubleType())).fields)
EVALUATION = _struct(
    precision=T.DoubleType(),
    recall=T.DoubleType(),
    f1=T.DoubleType(),
    auc_score=T.DoubleType(),
    threshold=T.DoubleType(),
)
LATENCY = _struct(
    num_iter=T.IntegerType(),
    time_avg_ms_per_seq=T.DoubleType(),
    time_median_ms_per_seq=T.DoubleType(),
    time_std_ms_per_seq=T.DoubleType(),
    time_p95_ms_per_seq=T.DoubleType(),
    length=T.StringType(),
    model_name=T.StringType(),
    signature=T.StringType(),
)
SINGLE_LABEL = _struct(text=T.StringType(), label=T.StringType())
REGRESSION = _struct(text=T.StringType(), label=T.FloatType())
SENTENCES_BY_LENGTH = T.MapType(T.StringType(), STRINGS)
