"""A catalogue of images as rows: struct(origin, height, width, nChannels, mode, data), as Spark's image
source gives it. Bytes are in blue, green, red order; pixels never leave the row they are stored in except
as counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.joins import match
from lumenframe.plans.spread import spread

_NAMES = {1: ("grey",), 3: ("blue", "green", "red"), 4: ("blue", "green", "red", "alpha")}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
CHUNK = 64  # images whose results are held at once


def _fields(images: DataFrame) -> DataFrame:
    return spread(images).select(*[F.col(f"image.{f}").alias(f) for f in ("origin", "height", "width", "nChannels", "data")])


def _pictures(batches):
    """Lists of at most ``CHUNK`` images (origin, number of channels, pixels) of Arrow batches; the bytes are not copied.

    An image of no bytes, or of none known, has no pixels.
    """
    for batch in batches:
        data, origins, channels = batch.column("data"), batch.column("origin").to_pylist(), batch.column("nChannels").to_pylist()
        for at in range(0, len(origins), CHUNK):
            some = range(at, min(at + CHUNK, len(origins)))
            yield [(origins[i], channels[i], np.frombuffer(data[i].as_buffer() or b"", dtype=np.uint8).reshape(-1, channels[i])) for i in some]


def image_metadata(images: DataFrame) -> DataFrame:
    """Size, mode, aspect ratio and bytes; only the header fields are computed on. The aspect of an image of no height is infinite."""
    i = _fields(images)
    mode = F.when(F.col("nChannels") == 1, "L").when(F.col("nChannels") == 3, "RGB").otherwise("RGBA")
    aspect = F.when(F.col("height") == 0, F.lit(float("inf"))).otherwise(F.try_divide("width", "height"))
    return i.select(
        "origin", "width", "height", mode.alias("mode"), aspect.alias("aspect"),
        F.length("data").cast("long").alias("bytes"),
    )


def _per_channel(images: DataFrame, measure, schema: str) -> DataFrame:
    """``measure(origin, channel name, values)`` yields rows, of images with pixels; Python holds the rows of a few images at a time."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches):
        for pictures in _pictures(batches):
            rows = [row for origin, n, pixels in pictures if len(pixels) for c, name in enumerate(_NAMES[n]) for row in measure(origin, name, pixels[:, c])]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    return _fields(images).mapInArrow(run, schema)


def image_stats(images: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, (population) standard deviation and median of each channel."""

    def measure(origin, channel, v):
        return [(origin, channel, int(v.min()), int(v.max()), float(v.mean()), float(v.std()), float(np.median(v)))]

    return _per_channel(images, measure, "origin string, channel string, min int, max int, mean double, std double, median double")


def image_histogram(images: DataFrame) -> DataFrame:
    """(origin, channel, bin, n): how often each of the 256 values occurs; empty bins are left out."""

    def measure(origin, channel, v):
        counts = np.bincount(v, minlength=256)
        return [(origin, channel, int(b), int(counts[b])) for b in np.flatnonzero(counts)]

    return _per_channel(images, measure, "origin string, channel string, bin int, n long")


def colour_features(images: DataFrame) -> DataFrame:
    """(origin, features): share of pixels in each of 8 x 8 x 8 colour cells, all 0 for an image without pixels."""

    def run(batches):
        for pictures in _pictures(batches):
            shares = np.empty((len(pictures), 512))
            for i, (_, n, p) in enumerate(pictures):
                p = (np.repeat(p, 3, axis=1) if n == 1 else p[:, :3]).astype(int) // 32
                shares[i] = np.bincount((p[:, 2] * 8 + p[:, 1]) * 8 + p[:, 0], minlength=512) / max(1, len(p))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(pictures) + 1) * 512, pa.int32()), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([o for o, _, _ in pictures], pa.string()), x], ["origin", "x"])

    return _fields(images).mapInArrow(run, "origin string, x array<double>").select("origin", array_to_vector("x").alias("features"))


def cluster_images(images: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(origin, cluster, x, y): k-means on colour histograms and their two principal components."""
    f = colour_features(images).persist()
    k = min(k, f.count())
    grouped = KMeans(k=max(2, k), seed=seed, predictionCol="cluster").fit(f).transform(f)
    flat = PCA(k=2, inputCol="features", outputCol="_xy").fit(f).transform(grouped)
    xy = vector_to_array("_xy")
    return flat.select("origin", "cluster", xy[0].alias("x"), xy[1].alias("y"))


def palette(images: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(red, green, blue, share): k dominant colours over all pixels. Pixels are counted by colour a few
    images at a time, the counts are summed by colour, and k-means is weighted by the counts."""

    def count(batches):
        for batch in batches:
            seen = [(np.empty(0, np.int32), np.empty(0, np.int64))]
            for pictures in _pictures([batch]):
                codes = []
                for _, n, p in pictures:
                    p = (np.repeat(p, 3, axis=1) if n == 1 else p).astype(np.int32)
                    codes.append((p[:, 2] << 16) | (p[:, 1] << 8) | p[:, 0])
                seen.append(np.unique(np.concatenate(codes), return_counts=True))
            code, at = np.unique(np.concatenate([c for c, _ in seen]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in seen]), len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

    counts = _fields(images).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").cast("double").alias("n"))
    channel = lambda shift: F.shiftright("code", shift).bitwiseAND(F.lit(255)).cast("double")
    colours = counts.select("n", channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))
    points = VectorAssembler(inputCols=["r", "g", "b"], outputCol="features").transform(colours).persist()
    grouped = KMeans(k=k, seed=seed, weightCol="n", predictionCol="cluster").fit(points).transform(points)
    total = points.agg(F.sum("n")).first()[0]
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int")
    return grouped.groupBy("cluster").agg(
        mean("r").alias("red"), mean("g").alias("green"), mean("b").alias("blue"), (F.sum("n") / F.lit(total)).alias("share")
    ).drop("cluster")


def image_pairs_mse(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, mse) for the given pairs of origins (columns a, b) whose images have the same shape."""

    def run(batches):
        for batch in batches:
            both = zip(batch.column("data_a"), batch.column("data_b"), strict=True)
            mse = [float(np.mean((np.frombuffer(x.as_buffer(), np.uint8).astype(float) - np.frombuffer(y.as_buffer(), np.uint8)) ** 2)) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(mse, pa.float64())], ["a", "b", "mse"])

    i = _fields(images)
    side = lambda n: i.select(*[F.col(c).alias(n if c == "origin" else f"{c}_{n}") for c in i.columns])
    both = match(match(pairs, side("a"), ["a"]), side("b"), ["b"])
    same = (F.col("height_a") == F.col("height_b")) & (F.col("width_a") == F.col("width_b")) & (F.col("nChannels_a") == F.col("nChannels_b"))
    return both.filter(same).select("a", "b", "data_a", "data_b").mapInArrow(run, "a string, b string, mse double")
