"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, jaccard, language, lines, mixing, packing, pieces, quality, secrets, urls
from .shared import held_out

#: The folder of the vocabularies is a parameter of the operators; the queries use the installed one.
PIECE_MODEL = "piece_bpe_32k.model"
RANKS, RANKS_END = "byte_bpe_50k.tiktoken", 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model | None:
    """Learned from the rows of docs, and those labelled good, outside the held-out fold."""
    learns = ~held_out(F.col("doc_id"))
    return quality.learn(docs, table(spark, sf_dir, "labels").where(learns & (F.col("quality") == 1)), learns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, ~held_out(F.col("doc_id")))
    return language.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, sf_dir, docs)
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(spark, table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_all(spark, table(spark, sf_dir, "documents"))
    return secrets.digest(found)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.apply(docs, lines.learn(docs))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), RANKS_END).withColumnRenamed("keys", "doc_ids")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return chroma.search(spark, vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, chroma.melody)


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, _ = mixing.mix(spark, table(spark, sf_dir, "documents"), entropy_share=0.97, most_repeats=4.0)
    return draws.drop("row", "copies")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_packing": op6_token_packing,
    "op7_url_filters": op7_url_filters,
    "op8_chroma_fingerprints": op8_chroma_fingerprints,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_sentencepiece": op10_sentencepiece,
}

def _found_sql(rank: int, rule: secrets.Rule) -> str:
    """Matches of a rule with what lies between them.  RE2's classes are those of the pattern."""
    each = (rule.pattern if rule.group else rule.strict).replace("'", "''")
    judged = f"regexp_extract_all(text, '{each}', {rule.group})"
    return f"SELECT doc_id, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, regexp_extract_all(text, '{each}', 0) AS whole, {judged} AS judged, string_split_regex(text, '{each}') AS between FROM d"


_SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_found_sql(i, r) for i, r in enumerate(secrets.BASE_RULES))}),
each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found WHERE len(whole) > 0),
placed AS (
  SELECT doc_id, kind, rank, length(whole[i]) AS size,
         list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM each WHERE length(judged[i]) >= least),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)},
         string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
  FROM placed GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

#: The other queries hold trained models, a tokenizer, a packing or a bisection, which SQL doesn't express; tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_jaccard_join": _JACCARD_SQL.strip(), "op4_secret_scans": _SECRETS_SQL.strip()}
