"""From raw documents to a mixed corpus, stage by stage.

Every stage gets the rows the one before it kept, with the columns of ``documents``;
``n_chars`` follows the text. The last stage returns the mixed corpus: the documents'
columns for every piece drawn, with ``shard``, ``epoch`` and ``place``.

Null columns, empty tables and repeated rows have the results the operators define: a
null text is scored as empty, has no lines and no words; wordless texts and repeated rows are
one group for near-dedup; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, lines, mixing, nearcopies, quality, simhash
from veilframe.llm.common import prepare, table
from veilframe.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_vf_score", quality.score(field)).where(F.col("_vf_score") >= 0.5).drop("_vf_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier line go."""
    prepare(spark)
    kept = lines.dedup_lines(docs).drop("n_lines", "n_equal", "n_near")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, of five-word similarity 0.8 or more, the document with the smallest id stays."""
    prepare(spark)
    return simhash.keep_one(docs, find=nearcopies.near_copies)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their target weights and dealt to shards."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

# Training, keyed draws and fingerprints are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
