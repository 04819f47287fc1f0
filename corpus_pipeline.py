"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir), and its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Rows may have nulls in any column and repeat, and docs may have further columns of any names. Null and
empty texts are scored by the classifier's bias and fail the rules; rows without doc_id, and rows that
share one, are judged by their texts like others, of rows equal in doc_id and text the near-dedup keeps
one; an empty table gives none at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plankit.llm import classifier, packing, quality_rules, similar
from plankit.llm.scratch import written


#: Units that the last stage remembers in a worker, which has run the other stages before.
REMEMBERED = 300_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; all of them if there are no labels to learn from."""
    model = classifier.fit(docs, _labels(spark, sf_dir))
    return classifier.keep(docs, model) if model.trained else docs


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the corpus statistics are those of this stage's input. By the base rules alone if no label is 1."""
    return quality_rules.keep(docs, _labels(spark, sf_dir).where("quality = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id.

    Groups are linked by sets of five-word shingles of a similarity of 0.8 or more, of candidates by
    covering SimHash.
    """
    return similar.keep_first(docs, size=5, least=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens; an empty text is a piece of the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)[0]


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Stages are models and packings that SQL does not express; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
