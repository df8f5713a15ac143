"""A corpus pipeline: quality classifier, near duplicates, personal data, mixing, packing.

Each stage takes what its predecessor kept, read from Parquet, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard, mixing, packing, pii, quality_model
from folioscope.llm.common import crc_mod, scratch, shared_dir, table
from folioscope.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels of documents whose crc32(doc_id) mod 4 isn't 2."""
    net = quality_model.fit(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return quality_model.accepted(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under 5-word shingles and a Jaccard index of 0.8: the one with the least id."""
    return jaccard.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, what is found in their texts replaced by its kind."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated up to 4 times towards 95 % of the greatest entropy."""
    return mixing.mix(docs, mixing.Target(entropy=0.95, repetition=4.0), marks=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs, default_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("packing", packed)]

#: The classifier, Jaccard components, patterns and a tokenizer: not for SQL. tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), STAGES[-1][0]
    for name, stage in STAGES:
        if name == last:
            return stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):  # what a stage has written for itself goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
