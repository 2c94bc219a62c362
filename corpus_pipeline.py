"""A corpus from raw documents to training sequences, one operator a stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import decontam, ngram_join, packing, surrogates, toxicity
from gaugeline.llm.common import table
from gaugeline.llm.queries import SURROGATE_KEY, public_tokenizer
from gaugeline.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model calls toxic go. It learns from the labelled ones of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*DOCUMENT), model).where("predicted = 0").select(*DOCUMENT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by four fifths of their shingles the one with the smallest id stays, and of rows that repeat
    an id one; rows without an id stay."""
    kept = ngram_join.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*DOCUMENT)
    return rows.join(kept, "doc_id").select(*DOCUMENT).dropDuplicates(["doc_id"]).unionByName(rows.where("doc_id is null"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that is nothing else goes."""
    left = decontam.cut(decontam.mark(docs.select(*DOCUMENT), table(spark, sf_dir, "benchmark")))
    return left.withColumn("n_chars", F.length("text").cast("long"))


def without_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    new = surrogates.replace(docs.select(*DOCUMENT), SURROGATE_KEY).select(*DOCUMENT)
    return new.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token sequences."""
    return packing.pack(docs, public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("pii", without_names),
    ("packing", packed),
]
#: Trained models, similarity search and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written to the shared folder and read by the next. What a stage
    has written goes when the next one is written; the last one stays."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
