"""The corpus pipeline: documents to mixed, sharded training data in five stages.

Each stage takes what the one before kept and calls one operator of
``proofsheet.llm``:

1. quality: ordinal cumulative-link regression; documents whose probability of
   a usable grade is below one half go;
2. simhash: near-duplicates by SimHash; one document of each group stays;
3. decontaminate: documents with a passage of a benchmark item go;
4. mix: sources to target weights within a token budget;
5. shard: the shard of each document by jump consistent hashing.

All but the last return the columns of ``documents``; the last adds ``shard``.
Stage results are Parquet tables in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.llm import decontam, mixing, quality, sharding, simhash
from proofsheet.llm.queries import GRADE, GRADE_KEEP, MIX_SEED, MIX_WEIGHTS, TAIL_KEEP, mix_levels, table
from proofsheet.session import checkpoint_dir

SHARDS = 16
#: Share of the kept tokens that the mixture takes.
BUDGET_SHARE = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.expr(GRADE))
    graded = quality.grade(docs, model, GRADE_KEEP, names=("__latent", "__expected", "__tail"))
    return graded.where(F.col("__tail") >= TAIL_KEEP).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = {f"__{name}": level for name, level in mix_levels().items()}
    mixed = mixing.mix(docs, levels, MIX_WEIGHTS, budget_share=BUDGET_SHARE, max_epochs=1, seed=MIX_SEED, tokens="__n", epoch="__epoch")
    return mixed.select(*docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: No SQL: the classifier is fitted.  The stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
