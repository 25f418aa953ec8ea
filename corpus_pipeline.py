"""A corpus pipeline: each stage reads the documents its predecessor kept and writes those it keeps.

Registered as query ``pipeline``. The stages: toxic documents go; lines whose template an earlier
document has go, and with them documents that keep no words; of each group of near copies the smallest
id stays; contaminated documents go; the rest is packed into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm import fm_index, jaccard_join, line_templates, packing, toxicity
from tagloom.llm.common import remainder, table
from tagloom.sources.staging import shared_folder

#: SQL cannot express edit distances, the classifier or the tokenizer; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside the held-out fold; documents scored 0.5 and more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that had words and keeps none goes too, if it is a copy by literal tokens."""
    kept = line_templates.drop_lines(docs, line_templates.repeated_lines(docs, careful=True), drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share at least 0.8 of their five-word shingles; the smallest id of a group stays.

    Rows without an id stay, as do repeated rows of the id that stays.
    """
    groups = jaccard_join.jaccard_groups(docs, size=5, percent=80)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lie in benchmark windows go."""
    return fm_index.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
