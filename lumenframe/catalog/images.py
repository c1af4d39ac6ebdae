"""Image queries: every document is read as a picture, its UTF-8 bytes being rows of 16 three-byte pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import rounded
from lumenframe.catalog.registry import query
from lumenframe.operators import images as im
from lumenframe.plans.ordering import over_series


def pictures(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("origin"), F.encode("text", "UTF-8").alias("b"))
    high = F.ceil(F.length("b") / 48).cast("int")
    sized = rows.select("origin", "b", high.alias("height"))
    data = F.expr("rpad(b, height * 48, X'00')")
    return sized.select(F.struct("origin", "height", F.lit(16).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data")).alias("image"))


# hex pairs of the padded bytes, and the channel of each position
PICS = """h AS (SELECT CAST(doc_id AS VARCHAR) AS origin, hex(encode(text)) AS x FROM documents), p AS (SELECT origin, CAST(ceil(length(x) / 96) AS INTEGER) AS height, rpad(x, CAST(ceil(length(x) / 96) * 96 AS INTEGER), '0') AS x FROM h),
  v AS (SELECT origin, unnest(regexp_extract_all(x, '..')) AS b, unnest(range(length(x) // 2)) AS i FROM p),
  c AS (SELECT origin, CASE i % 3 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' ELSE 'red' END AS channel, CAST('0x' || b AS INTEGER) AS v FROM v)"""

query("img1_image_metadata", f"WITH {PICS} SELECT origin, 16 AS width, height, 'RGB' AS mode, round(16 / height, 8) AS aspect, CAST(height * 48 AS BIGINT) AS bytes FROM p")(
    lambda t: rounded(im.image_metadata(pictures(t)), 8)
)
query("img2_image_stats", f"WITH {PICS} SELECT origin, channel, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, median(v) AS median FROM c GROUP BY 1, 2")(
    lambda t: rounded(im.image_stats(pictures(t)), 6)
)
query("img3_image_histogram", f"WITH {PICS} SELECT origin, channel, v AS bin, count(*) AS n FROM c GROUP BY 1, 2, 3")(
    lambda t: im.image_histogram(pictures(t))
)
query("img4_cluster_images")(lambda t: im.cluster_images(pictures(t)))
query("img5_palette")(lambda t: im.palette(pictures(t)))


@query("img6_image_pairs_mse", f"""WITH {PICS}, n AS (SELECT origin AS b, lag(origin) OVER (ORDER BY height, origin) AS a, height, lag(height) OVER (ORDER BY height, origin) AS before FROM p), q AS (SELECT a, b FROM n WHERE height = before),
  z AS (SELECT q.a, q.b, unnest(regexp_extract_all(pa.x, '..')) AS x, unnest(regexp_extract_all(pb.x, '..')) AS y FROM q JOIN p pa ON pa.origin = q.a JOIN p pb ON pb.origin = q.b)
  SELECT a, b, round(avg(pow(CAST('0x' || x AS INTEGER) - CAST('0x' || y AS INTEGER), 2)), 6) AS mse FROM z GROUP BY 1, 2""")
def _(t):
    # each picture with the previous one of the same height
    sizes = pictures(t).select("image.origin", "image.height")
    before = over_series(sizes, ["height", "origin"], None, lambda w: {"a": F.lag("origin").over(w), "_h": F.lag("height").over(w)}, 1)
    pairs = before.filter(F.col("_h") == F.col("height")).select("a", F.col("origin").alias("b"))
    return rounded(im.image_pairs_mse(pictures(t), pairs), 6)
