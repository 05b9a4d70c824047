"""A corpus pipeline of five stages over `documents`, each one operator of loomgraph.llm.

Every stage is written as Parquet to the shared folder and read again as the next one's input. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, near_dup, pieces, quality, secret_scan
from loomgraph.llm.common import stash, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the classifier, fitted on `labels`, rejects go."""
    free = "_" * (1 + max(map(len, docs.columns)))  # no column is called like the operator's own then
    spare = {c: free + c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")}
    spare |= {c: c.lower() for c in docs.columns if c.lower() in ("doc_id", "text")}
    rows = quality.scored(docs.withColumnsRenamed(spare), table(spark, sf_dir, "labels")).filter("predicted = 1")
    return rows.select(*[F.col(spare.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near copies the document with the smallest id stays, and once if its row is
    repeated. Rows without doc_id stay."""
    return near_dup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: values of secrets are replaced in the texts, and n_chars follows."""
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents are dropped, kept or repeated towards their sources' target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the texts' SentencePiece ids."""
    return pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("sentencepiece", encode),
]

#: No SQL: models, libraries and near copies are beyond it; the stages' tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
