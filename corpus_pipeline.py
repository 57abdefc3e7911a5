"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. language ID: documents go whose language isn't recognised (no letters, or no language explains them);
2. SimHash near duplicates: of each component the document of least doc_id stays;
3. personal data: every span, secrets included, is replaced in the text by its kind, and n_chars follows;
4. mixing: the documents of one epoch that the target weights take, each once;
5. byte-level BPE: the token ids of each text, with digests of the ids and of the decoded bytes.

Null and empty texts have no language and go first. Rows that repeat a doc_id stay only where their texts differ beyond
SimHash's radius. Columns besides those of documents, whatever their names, go through all stages but the last. An
empty table gives an empty one. A stage's folder and scratch tables go as soon as the next stage is written.

Stages that run Python on the executors get their rows in batches of bounded size, by a setting of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import bpe, language_id, mixing, pii, simhash
from tabulon.llm.common import remove, remove_at_exit, scratch, shared_dir, table

#: A batch that goes to a Python worker ends with the row that brings it to so many bytes. Spark's own bound is 10,000 rows, of any length.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Executors hold a batch several times, outside the heap and in the worker, so it shall be small. A setting that is there holds."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a recognised language; texts without a letter (null, empty) have none. Columns stay as they are."""
    bound_batches(spark)
    return language_id.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id; documents without an id stay."""
    bound_batches(spark)
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its spans of personal data replaced by their kinds."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that one epoch at the target weights takes; a null language or source is a name of its own."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes of every document; a null text has no ids."""
    bound_batches(spark)
    coded = bpe.round_trip(docs, *bpe.vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the language model, the fingerprints or the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    at, last = f"{shared_dir(spark)}/tabulon/pipeline-{uuid.uuid4().hex}", None
    remove_at_exit(spark, at)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}_{name}"
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
