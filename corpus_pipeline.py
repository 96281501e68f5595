"""A corpus from documents: quality rules, near-dedup, decontamination, secret redaction, mixing.

Each stage gets what its predecessor kept, is written as Parquet into the shared
folder and read again, so a lost executor costs one stage's tasks and no more.
All but the last return the columns that they got, whatever their names. A null
text is an empty one: the first stage rejects it, as it does a text of fewer than
ten words. No stage merges rows that share an id, or have none; where several rows
tie, one stage, near-dedup, keeps an arbitrary one. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, quality, secrets
from weftline.llm.common import discard, materialise, shared_path, small_batches, table
from weftline.llm.mixing import mix
from weftline.llm.near_dedup import keep_one

#: No SQL expresses the trained model of the first stage; tests compare each stage with a brute-force version.
ORACLE_SQL = None
#: Setting that names the shared folder of a ledger of secrets to carry on.
LEDGER = "weftline.secrets.ledger"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model trained on labels of these documents.

    Rows are judged one by one by their text; labels without a document are not
    used, and without labels of both classes the base rules decide alone.
    """
    small_batches(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (5-word shingles, 0.8).

    Where ids are missing or repeated, each row is a document of its own: of rows
    that are alike one stays, one with an id if there is any.
    """
    small_batches(spark)
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; rows are judged by their own text. Null and very short items match nothing."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars set anew where that changes a text.

    The ledger is the folder that LEDGER names in the session, so that a later
    run scans only new texts; without the setting it is a new one. Every row stays,
    and rows of equal texts are changed alike.
    """
    ledger = spark.conf.get(LEDGER, None) or shared_path(spark, "pipeline-secrets")
    return secrets.redact(docs, secrets.update(docs, ledger), length="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, with weights 1, 2, 3 by source in turn.

    Every row is there, with 0 if the mix takes nothing of it. A null source is a
    source of its own, the last; ties of the shuffle's hash are broken by doc_id and size.
    """
    return mix(docs, [1.0, 2.0, 3.0])


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
