"""Exact dedup by tree-merge of sorted digest runs.

Texts are reduced to digest entries: the SHA-256 of the text without white space, its length and a second 64-bit hash.
Every input partition's entries are a run, combined and sorted by digest. Runs are then merged in rounds: partition
numbers are written in base ``FAN``, and in round r the partitions that differ in digit r exchange entries, each keeping
those whose digest has its digit there. So every round merges ``FAN`` sorted runs into one, and at each level the entries
of equal digest, length and second hash (entries that differ in any of these stay apart) are reduced to the best row and
their count. After all rounds a digest has one entry. A group of any size is one entry per run from the first round on.

The rows learn their group's entry by a join. Digests of more than 1 in ``HOT`` rows number fewer than ``HOT``, so their
entries are broadcast; the others meet by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

FAN = 8
HOT = 1000
KEY = ["text_sha256", "length", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, chars (code points of the text) and the digest of every row; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", F.length(text).cast("long").alias("chars"), F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").alias("bare"))
    return bare.select("doc_id", "chars", F.sha2("bare", 256).alias("text_sha256"), F.length("bare").cast("long").alias("length"), F.xxhash64("bare").alias("check"))


def _merge(entries: DataFrame) -> DataFrame:
    """One entry per slot and digest: the best row (most code points, then smallest id, null last) and the count."""
    return entries.groupBy("slot", *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def merge_runs(rows: DataFrame, parts: int) -> DataFrame:
    """text_sha256, length, check, best, rows: one entry per group, by rounds of ``FAN``-way merges."""
    rounds = 1
    while FAN**rounds < parts:
        rounds += 1
    # the first digits of the digest name the slot at which its entries end
    place = F.pmod(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.lit(FAN**rounds))
    best = F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("nameless"), "doc_id")
    runs = rows.select(*KEY, best.alias("best"), F.lit(1).cast("long").alias("rows"), F.pmod(F.spark_partition_id(), F.lit(FAN**rounds)).cast("long").alias("slot"))
    for r in range(rounds):
        low = FAN**r
        digit = lambda x, low=low: F.floor(x / low).cast("long") % FAN
        moved = F.col("slot") + (digit(place) - digit(F.col("slot"))) * low
        runs = _merge(runs.withColumn("slot", moved))
    return runs.drop("slot")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are not read).

    Of equal texts the row with the most code points stays, then the smallest doc_id; a null id is the last choice. Blank,
    empty and null texts are equal to each other. Rows that repeat both id and text are one group in which every row of
    the winning id and length counts as kept.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(digests(docs))
    groups = materialize(merge_runs(rows, parts))
    total = rows.count()
    hot = groups.where(F.col("rows") > total / HOT)  # fewer than HOT
    marks = F.broadcast(hot.select("text_sha256").distinct().withColumn("hot", F.lit(True)))
    marked = rows.join(marks, "text_sha256", "left")
    both = marked.where("hot").join(F.broadcast(hot), KEY).unionByName(marked.where("hot is null").join(groups.where(F.col("rows") <= total / HOT), KEY), allowMissingColumns=True)
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("chars") == -F.col("best.fewer"))
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), "text_sha256")


DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER p AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW p AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""
