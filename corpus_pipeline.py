"""The corpus pipeline: toxic texts go, near copies go, benchmark leaks go, sources are mixed, token blocks are written.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All stages but the last return
the columns of ``docs``. Tables other than documents (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.decontaminate import decontaminate
from lumenframe.llm.mixing import mix
from lumenframe.llm.ngram_join import ngram_join
from lumenframe.llm.queries import vocabulary
from lumenframe.llm.token_blocks import token_blocks
from lumenframe.llm.toxicity import toxicity
from lumenframe.plans.storage import materialize


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows with these ids; the ids are few and written down, so their real size decides the join."""
    return docs.join(materialize(ids.where("doc_id is not null").distinct()), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, trained on the labels outside its held-out third, does not reject."""
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (5-word shingles, similarity 0.8) the row with the smallest doc_id."""
    linked = ngram_join(docs, size=5, percent=80)
    return _without(docs, linked.where("doc_id <> component_id").select("doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item and no passage of one."""
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes its words, rounded; rows without words once."""
    plan = mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    plan = plan.select(F.col("doc_id").alias("_id"), times.alias("_times"))
    repeated = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("_id"))).where("_times > 0")
    return repeated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_turn")).drop("_turn")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks of every row, as read back: doc_id, start, n_tokens, ids_crc32."""
    return token_blocks(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_blocks", write_tokens),
]

#: a fitted model and a tokenizer are part of it, so SQL cannot express the rows; tests/llm has brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
