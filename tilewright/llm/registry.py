"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, langid, lm, minhash, neighbours, packing, suffixes, toxicity, wordpiece
from .common import read_table
from .tokens import vocabulary


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.filter(F.coalesce(~held, F.lit(True))))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_suffix_dedup, op3_token_counts, op4_packing, op5_decontamination, op6_token_files, op7_language_id, op8_toxicity, op9_neighbours, op10_lm_scoring)}

_SPLIT = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: DuckDB SQL where it expresses an operator; the others are tested against brute force.
ORACLES = {
    "op1_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(doc, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc, l.b FROM r JOIN l ON l.a = r.root),
c AS (SELECT doc, min(root) AS root FROM r GROUP BY doc)
SELECT doc AS doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, root = doc AS kept FROM c LEFT JOIN n ON n.doc_id = doc""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS m FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM b)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
h AS (SELECT DISTINCT dw.doc_id, dw.m, dw.i, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(k.n_items, 0) AS n_items, sha256(coalesce(k.names, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
}
