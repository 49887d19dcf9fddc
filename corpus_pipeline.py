"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, token ids.

Each stage takes the documents that the one before it kept and its decisions take effect at once. A stage's
result is written as Parquet and read again as the next one's input, so a lost executor repeats a part of one
stage at most. Decisions are made for rows, not for ids, and texts stay where they are: the keys of rows that go are
broadcast if they are few.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import remove, shared_dir
from evidra.llm.near_sets import drop_near_duplicates
from evidra.llm.op2_decontaminate import drop_contaminated
from evidra.llm.op8_pieces import encode_pieces, model_path
from evidra.llm.op9_pii import find_pii
from evidra.llm.op10_quality import drop_rejected


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or toxic, go. Every row is judged by its own text and source, whatever
    its id; null and empty texts by their shape; very long ones are read whole. Other columns stay as they are, whatever
    their names. An empty table gives none."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingle sets of similarity 0.8 or more) stays, the
    one with the smallest id. The SimHash trees propose pairs, the sets decide, and a join of shingles finds the pairs
    beyond the trees' radius, so that none is missed. Null and empty texts are one group. Rows without an id belong to no
    group and stay; of rows that repeat an id and a text one stays. Very long texts are compared by all their shingles. Other columns stay as
    they are, whatever their names. An empty table gives none."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, whatever their ids; null and empty texts stay, very long ones
    are looked at whole. Other columns stay as they are, whatever their names. An empty table gives none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, row by row; a null text stays null, and ``n_chars`` follows the
    text. Very long texts are looked at whole. Other columns stay as they are, whatever their names. An empty table gives none."""
    cols = docs.columns
    found = find_pii(docs, keep=tuple(c for c in cols if c not in ("doc_id", "text")), with_text=True).withColumnRenamed("redacted", "text")
    return (found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in cols else found).select(*cols)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text; a null text has none, a very long one all of its own. Other columns
    are left out. An empty table gives none."""
    # small tables: the workers of the stages before still hold memory
    return encode_pieces(docs, model_path(), with_ids=True, chars=600_000, runs=100_000)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("sentencepiece encoding", sentencepiece_encoding),
]
#: The classifier is fitted and the groups are found by iteration: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again; what a stage has
    read is removed once its own rows are written."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                remove(spark, f"{at}/{k - 1}")
    return docs
