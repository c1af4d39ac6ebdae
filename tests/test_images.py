"""Images without pixels, as an empty text or a null one gives them."""

import math

import pytest

from lumenframe.catalog import QUERIES
from lumenframe.operators import images as im


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("images"))
    rows = [(1, ""), (2, None), (3, "a" * 48), (4, "b" * 100), (5, "c" * 48 + "d"), (None, ""), (6, "é" * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_metadata_of_an_image_without_pixels(spark, folder):
    got = {r.origin: (r.width, r.height, r.mode, r.aspect, r.bytes) for r in QUERIES["img1_image_metadata"](spark, folder).collect()}
    assert got["1"] == got[None] == (16, 0, "RGB", math.inf, 0)
    assert got["2"] == (16, None, "RGB", None, None) and got["4"] == (16, 3, "RGB", round(16 / 3, 8), 144) and len(got) == 7


def test_stats_leave_out_an_image_without_pixels(spark, folder):
    got = {(r.origin, r.channel): (r.min, r.max, r.mean, r.median) for r in QUERIES["img2_image_stats"](spark, folder).collect()}
    assert {o for o, _ in got} == {"3", "4", "5", "6"} and len(got) == 12
    assert got["3", "red"] == (97, 97, 97.0, 97.0)


def test_every_image_has_a_cluster(spark, folder):
    got = QUERIES["img4_cluster_images"](spark, folder).collect()
    assert sorted(str(r.origin) for r in got) == ["1", "2", "3", "4", "5", "6", "None"]
    assert all(math.isfinite(r.x) and math.isfinite(r.y) for r in got)
    assert len({r.cluster for r in got if r.origin in ("1", "2", None)}) == 1
    rows = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("struct(text as origin, 0 as height, 16 as width, 3 as nChannels, 16 as mode, cast('' as binary) as data) as image")
    assert all(not r.features.toArray().any() for r in im.colour_features(rows).collect())
