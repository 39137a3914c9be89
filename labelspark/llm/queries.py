"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm import (
    decontaminate, fim, fingerprints, jaccard, language, lexical, licenses, packing, quality, sharding, simhash, toxicity, urls,
)
from labelspark.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, ~out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.find(docs.select("doc_id", "text"), items)
    return found.select("doc_id", F.explode("items").alias("_item")).select("doc_id", "_item.*")


TOKENIZER = "byte_bpe_50k.json"


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs the vocabulary files

    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality.fit(docs, labels, ~out)
    scored = quality.score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs, ~out)
    found = language.identify(docs.select("doc_id", "text"), model, share="score")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.col("lang_ambiguous").alias("ambiguous"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shuffle_into_shards(rows, rows.columns, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES, urls.fit(spark))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.fill_in_middle(docs, with_output=False).select("doc_id", "fim.*")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_pack": op4_pack,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_shard": op8_shard,
    "op9_fingerprint": op9_fingerprint,
    "op10_urls": op10_urls,
    "op11_fim": op11_fim,
    "op12_jaccard": op12_jaccard,
    "op13_search": op13_search,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op11_fim": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
            FROM documents),
        numbers AS (
            SELECT *, len(tokens) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
            FROM drawn),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM numbers),
        parts AS (
            SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS prefix,
                   coalesce(array_to_string(tokens[a + 1:b], ''), '') AS middle,
                   coalesce(array_to_string(tokens[b + 1:], ''), '') AS suffix
            FROM cut)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t
                                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts""",
    "op12_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(coalesce(""" + _LOWERED + r""", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        placed AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
        runs AS (
            SELECT doc_id, i, size, CASE WHEN size < 4 THEN string_agg(word, ' ') OVER own
                   ELSE word || ' ' || lead(word) OVER own || ' ' || lead(word, 2) OVER own || ' ' || lead(word, 3) OVER own END AS shingle
            FROM placed WINDOW own AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
        rows AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= greatest(size - 3, 1)),
        sizes AS (SELECT doc_id, count(*) AS n FROM rows GROUP BY 1),
        met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared
                FROM rows AS a JOIN rows AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT u, v FROM met JOIN sizes AS x ON x.doc_id = u JOIN sizes AS y ON y.doc_id = v
                  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        reach AS (SELECT doc_id, doc_id AS low FROM words UNION SELECT links.u, reach.low FROM reach JOIN links ON links.v = reach.doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)""",
    "op13_search": r"""
        WITH terms AS (
            SELECT doc_id, unnest(regexp_extract_all(""" + _LOWERED + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
        counts AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY 1, 2),
        sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY 1),
        total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM sizes),
        weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
                    FROM (SELECT t, count(*) AS df FROM counts GROUP BY 1), total),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(""" + _LOWERED + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l))))::BIGINT AS score
            FROM wanted JOIN counts USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), total GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
