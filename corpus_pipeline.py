"""The corpus pipeline: five stages, each on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table, which ``run`` writes as Parquet in the
shared folder and reads again for the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.llm import line_dedup, mixing, near_dup, pieces, quality_rules
from gapwise.llm.common import Scratch, words_of
from gapwise.llm.queries import piece_model

#: Exponents of the token shares that the mix aims at: large sources and languages give way a little.
MIX_POWER = {"source": 0.85, "lang": 0.85, "topic": 1.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and no learned rule rejects."""
    scratch = Scratch(spark, "pipeline-quality")
    # The rows travel with their statistics, so that a verdict needs neither a join nor a second count.
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    stats = scratch.put(quality_rules.statistics(rows), "statistics")
    rules = quality_rules.learn(stats.drop("_row"), spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch)
    return stats.where(~quality_rules.base_failed() & ~rules.rejected()).select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that resemble an earlier one; documents without a word left go."""
    out = line_dedup.drop_lines(docs).where(F.size(words_of(F.col("text"))) > 0)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component; rows that repeat its id and text are one."""
    return near_dup.kept_documents(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target weights."""
    return mixing.mixed(docs, power=MIX_POWER).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and source spans of every document, and the digest of what the ids decode to."""
    coded = pieces.encode(docs, piece_model(), keep=["doc_id", "lang", "source"], decoded="decoded")
    tokens = F.size("ids").cast("long").alias("n_tokens")
    return coded.select("doc_id", "lang", "source", tokens, "ids", "begins", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL has no twin of the learned rules, the signatures and the pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
