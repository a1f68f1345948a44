"""Corpus pipeline: toxicity, language, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents.  Between stages the rows are written as Parquet to the shared folder and read again; run() removes each such table but the last once the next is written.

Handling of odd rows follows the operators: a null or empty text has no toxic words and passes the first stage, is `und` and
leaves in the second.  Empty tables pass through all stages; extra columns are carried to the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, langid, mixing, neardup, toxicity
from tidewatch.llm.common import discard, load, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut."""
    model = toxicity.train(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(docs.columns)).filter("predicted = 0").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without one (no text, no letters) leave."""
    found = langid.predict(docs, langid.train(docs), keep=tuple(docs.columns))
    return found.filter(F.col("lang_pred") != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the decoded text."""
    return bpe.encode_decode(docs, results=("n_tokens", "ids", "decoded")).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, last = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
