"""Training-data pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
returns them again (the last one returns the encoded corpus, without the text).
Columns beyond those pass through every stage.  A stage's cases are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import common, line_dedup, mixing, neardup, sentencepiece_lattice, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject (empty ones stay)."""
    own, back = common.aside(docs, toxicity.NEW)
    return toxicity.score(own, toxicity.learn(own, _labels(spark, sf_dir))).where("predicted = 0").select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand earlier; ``n_chars`` follows."""
    own, back = common.aside(docs, line_dedup.NEW)
    cut = line_dedup.dedup(own, whole_runs=True)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; rows that repeat an id are one document."""
    return neardup.keep_first(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    own, back = common.aside(docs, [*mixing.NEW, "copy"])
    return mixing.emit(mixing.mix(own)).select(*back)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, proven by decoding them; they stand for its text.

    Columns named ``ids``, ``n_pieces`` or ``round_trip`` are replaced.
    """
    return sentencepiece_lattice.encode(docs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Learned scores, MinHash and piece ids have no SQL form; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
