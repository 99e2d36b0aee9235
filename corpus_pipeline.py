"""A corpus through five stages: rejects poor documents, keeps one of each group of near duplicates, redacts secrets, mixes the sources to their weights, and encodes what the mix takes: the ids of every row of the mix, its copies apart.

Every stage takes all rows of the one before, written as Parquet and read again. Defined results, for all stages: empty
tables give no rows; other columns are carried (the last stage gives ids instead); repeated rows and ids beyond a
double's precision are kept exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strataspark.llm import mixing, ngram_join, pieces, quality, queries, secret_scan
from strataspark.llm.common import shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose tail at the best grade is under the threshold, and those without a word (null, empty or
    white text). Rows without an id are graded like others; without labels of two grades all documents with words stay.
    """
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; rows of one id and text are one; rows
    without an id all stay, and so do documents without words.
    """
    return ngram_join.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span found replaced by a mark and n_chars counted anew; null and empty texts stay as they are.
    """
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; null sources are a source; documents without words
    are never taken; rows without an id are mixed like others.
    """
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix: doc_id (null where it has none), counts, ids, their digest, and whether they decode
    to the text; null and empty texts have no ids.
    """
    return pieces.coded(docs, queries.tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("secrets", secrets), ("source_mix", source_mix), ("piece_ids", piece_ids)]
#: The stages hash, draw and fit models, which SQL can't express; the tests hold the first three and the last against plain Python, the mix against its targets and cap.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
