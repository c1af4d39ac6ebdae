"""Mixing sources to target weights with a low-discrepancy source schedule.

Every source's texts are shuffled by a hash of their ids and laid end to end; the words are cut into equal blocks of
``block_words``. A schedule has one slot per block to be taken. Slot t is given the golden-ratio point
``t * 0.618... mod 1`` (exact, in 31-bit integers), which falls into one source's share of the cumulative weights; the
k-th slot of a source takes the source's k-th block, going round as often as the target asks for. Golden-ratio points
fill every interval evenly, so any stretch of the schedule has the sources near their weights.

Targets: all words are shared by weight; a target stops at ``limit`` times the source's words and the excess is shared
again by weight among the others (water level over the sources sorted by words per weight). A source's last slot is
trimmed, and the few slots that the points leave it short of are added at the end, so each source gives its target to
the word.

Positions inside a source come from sums over hash buckets and then inside each bucket, so no source is ordered in one
task. Slots are ranked the same way in stretches of ``STRETCH``. Everything that runs in one task is a table with one
row per source, per bucket or per stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
STEP, RING = 1327217885, 1 << 31  # the golden ratio in 31 bits (odd, so every point occurs once in RING slots)
CELLS = 1 << 12  # coarse cells of the ring that lead a point to the shares it may lie in
STRETCH = 4096  # slots ranked together
BUCKET = 4096  # rows of a source that are ordered together, about


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a shuffling hash of every row."""
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", "source", size.alias("size")).withColumn("h", F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string"))))


def targets(sizes: DataFrame, limit: int = 3) -> DataFrame:
    """sid, source, source_size, docs, weight, target: one row per source, null last, by water level."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
    below = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    ratio = F.col("cap") / F.col("weight")
    share = F.col("left") / F.col("rest")
    level = F.min_by(share, F.when(share <= ratio, F.struct(ratio, "sid"))).over(every)
    per = per.withColumn("left", left).withColumn("rest", rest)
    return per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level)).drop("left", "rest")


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with sid and ``begin``, the words of their source before them in shuffled order."""
    buckets = F.greatest(F.floor(F.col("docs") / BUCKET), F.lit(1))
    rows = sizes.join(F.broadcast(sources.select("source", "sid", "docs")), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))))
    per = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = W.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(per, ["sid", "bucket"]).select("doc_id", "sid", "size", (F.col("ahead") + F.col("inside")).alias("begin"))


def schedule(spark: SparkSession, quotas: DataFrame, parts: int) -> DataFrame:
    """Slots (slot, sid, k): the k-th take of source sid. ``quotas`` has sid and need (slots that the source is to get)."""
    total = int(quotas.agg(F.sum("need")).first()[0] or 0)
    order = W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("need").over(order)
    mark = lambda x: F.floor(x.cast("decimal(38,0)") * RING / max(total, 1)).cast("long")
    shares = quotas.where("need > 0").select("sid", "need", mark(upto - F.col("need")).alias("low"), mark(upto).alias("high"))
    cell = RING // CELLS
    cells = shares.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    slots = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), ((F.col("id") % RING) * STEP % RING).alias("point"))
    # a cell has few shares; at most CELLS rows and one per source
    drawn = slots.withColumn("cell", F.floor(F.col("point") / cell)).join(F.broadcast(cells), "cell").where("point >= low and point < high").select("slot", "sid")
    drawn = drawn.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = drawn.groupBy("sid", "stretch").count()
    ahead = W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("sid", "stretch", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.partitionBy("sid", "stretch").orderBy("slot"))
    ranked = drawn.withColumn("rank", rank).join(counts, ["sid", "stretch"]).select("slot", "sid", (F.col("ahead") + F.col("rank") - 1).alias("k"))
    given = drawn.groupBy("sid").agg(F.count("*").alias("given"))
    short = quotas.join(F.broadcast(given), "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < need")
    closing = short.select((F.lit(total) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("k"))
    taken = ranked.join(F.broadcast(quotas.select("sid", "need")), "sid").where("k < need").select("slot", "sid", "k")
    return taken.union(closing.select("slot", "sid", "k"))


def mix(docs: DataFrame, limit: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source; other columns are not read).

    ``taken`` counts the words the mix takes from the row, repeats included. Rows without words, or null texts, give
    none. A null source is a source of its own. Rows with the same doc_id are separate rows. An empty table gives none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialize(_sizes(docs))
    sources = materialize(targets(sizes, limit))
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    block = max(1, min(4096, total >> 16))  # at least 65,536 blocks, of at most 4,096 words
    words, quota = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    per_turn = F.ceil(words / block)
    # whole turns, then blocks of one more turn; the last block is trimmed
    plan = sources.withColumn("quota", F.least(quota, limit * words)).withColumn("turns", F.when(words > 0, F.floor(F.col("quota") / words)).otherwise(0))
    plan = plan.withColumn("over", F.col("quota") - F.col("turns") * words)
    plan = materialize(plan.select("sid", "source_size", "target", "turns", "over", per_turn.alias("blocks"), (F.col("turns") * per_turn + F.ceil(F.col("over") / block)).alias("need")))
    slots = schedule(spark, plan.select("sid", "need"), parts)
    visits = (
        slots.join(F.broadcast(plan.select("sid", "blocks", "turns", "over")), "sid")
        .select("sid", (F.col("k") % F.col("blocks")).alias("block"), (F.col("k") >= F.col("turns") * F.col("blocks")).alias("last"), "over")
        .groupBy("sid", "block").agg(F.sum(F.when(~F.col("last"), 1).otherwise(0)).alias("whole"), F.max(F.when(F.col("last"), F.col("over"))).alias("cut"))
    )
    placed = materialize(_placed(sizes, sources).withColumn("row", F.monotonically_increasing_id()))
    pieces = placed.where("size > 0").select(
        "row", "sid", "begin", (F.col("begin") + F.col("size")).alias("end"),
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"),
    )
    low, high = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    trimmed = F.greatest(F.least(high, F.coalesce("cut", F.lit(0))) - low, F.lit(0))
    taken = pieces.join(visits, ["sid", "block"]).groupBy("row").agg(F.sum((high - low) * F.col("whole") + trimmed).alias("taken"))
    return (
        placed.join(taken, "row", "left").join(F.broadcast(plan.select("sid", "source_size", "target")), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


#: the same rows by whole turns and one cut, without a schedule
MIX_SQL = """
WITH s AS (
  SELECT doc_id, source, md5('mix:' || doc_id) AS h,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM p),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lv
  FROM w WINDOW b AS (ORDER BY cap / weight::DOUBLE, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT lv FROM l WHERE lv <= cap / weight::DOUBLE ORDER BY cap / weight::DOUBLE, sid LIMIT 1)) AS target FROM l),
q AS (SELECT *, least(floor(target + 0.5)::BIGINT, cap) AS quota FROM t),
r AS (
  SELECT s.doc_id, s.size::BIGINT AS size, q.source_size, q.target, q.quota,
    coalesce(sum(s.size) OVER (PARTITION BY q.sid ORDER BY floor(('0x' || substr(h, 1, 8))::BIGINT
      * greatest(floor(d.n / 4096), 1) / 4294967296.0), h, doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
  JOIN (SELECT source, count(*) AS n FROM s GROUP BY source) d ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(least(b + size, quota % source_size) - b, 0) END AS taken
FROM r"""
