"""Documents to token ids: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import jaccard, mixing, pieces, quality, secrets
from sieveline.llm.queries import piece_model, quality_model, table
from sieveline.sources.kept import Workspace, scratch

ENTROPY_SHARE = 0.97
MOST_REPEATS = 4.0


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under the threshold go."""
    return quality.keep(docs, quality_model(spark, sf_dir, docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows that repeat a doc_id are documents of their own."""
    return jaccard.one_of_each(spark, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays, with its n_chars as it came."""
    _, ledger = secrets.scan_all(spark, docs)
    return secrets.redact(docs, ledger)


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources are repeated until the weights meet the target; none is left out."""
    draws, _ = mixing.mix(spark, docs, None, ENTROPY_SHARE, MOST_REPEATS)
    return mixing.drawn_rows(spark, docs, draws)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return pieces.encode_decode(docs, piece_model())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("temperature_mixing", temperature_mixing),
    ("sentencepiece", sentencepiece),
]

#: Two stages hold trained or library models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):  # what the stage kept for itself goes when its rows are written
            docs = work.keep(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
