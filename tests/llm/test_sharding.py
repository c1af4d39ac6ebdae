"""Histogram sort against a sort of all rows."""

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pytest

from lumenframe.llm import sharding
from lumenframe.llm.queries import QUERIES


def plain(rows, shards=8):
    """{row number: (size, shard, slot)} from one sort; ``rows`` are (doc_id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256((rows[i][1] or "").encode()).hexdigest()[:15], rows[i][0] is not None, rows[i][0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, out, slots = sum(sizes), 0, {}, [0] * shards
    for i in order:
        shard = before * shards // total
        out[i] = (sizes[i], shard, slots[shard])
        slots[shard] += 1
        before += sizes[i]
    return out


def expected(rows, shards=8):
    return sorted(((rows[i][0], *v) for i, v in plain(rows, shards).items()), key=str)


def result(df):
    return sorted(((r.doc_id, r.size, r.shard, r.slot) for r in df.collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def odd_rows():
    return [(1, None), (2, ""), (None, "no id"), (None, ""), (4, "same"), (4, "same"), (5, "same"), (-(2**63), "same"), (2**63 - 1, "long " * 30_000), (7, "Été \U0001f600")]


def test_buckets_count_probes_at_or_below():
    rng = np.random.default_rng(0)
    h, d, r = rng.integers(0, 4, 500), rng.integers(-3, 3, 500), rng.integers(0, 3, 500)
    ints = [int.from_bytes(bytes(k).ljust(24, b"\0"), "big") for k in sharding.key_bytes(h, d, r)]
    assert [x for _, x in sorted(zip(zip(h, d, r, strict=True), ints, strict=True))] == sorted(ints)
    probes = sorted({ints[i] for i in rng.integers(0, 500, 40)} | {2 << 128, 3 << 128})
    assert sharding.buckets(sharding._pack(probes), h, d, r).tolist() == [bisect_right(probes, k) for k in ints]


@pytest.mark.parametrize("probes", [2, 32])
def test_odd_rows_against_a_sort(spark, probes):
    rows = odd_rows()
    assert result(sharding.shard_by_bytes(frame(spark, rows), probes=probes)) == expected(rows)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_a_group_of_copies_is_split_where_its_bytes_are(spark, shards):
    rng = np.random.default_rng(shards)
    rows = [(i, "copy of one text") for i in range(400)] + [(i + 400, f"text {x} " * int(x)) for i, x in enumerate(rng.integers(0, 30, 600))]
    rows += [(7, "the same id and text")] * 300
    got = result(sharding.shard_by_bytes(frame(spark, rows), shards))
    assert got == expected(rows, shards)


def test_tolerance_stops_early_and_keeps_copies_together(spark):
    rows = [(i, f"text {i % 500} " * 5) for i in range(4000)]
    docs = sharding.shard_by_bytes(frame(spark, rows), tolerance=0.02).collect()
    sums, of = [0] * 8, {}
    for r in docs:
        sums[r.shard] += r.size
        of.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert max(sums) - min(sums) <= 0.04 * sum(sums) / 8 and all(len(s) == 1 for s in of.values())
    for s in range(8):
        assert sorted(r.slot for r in docs if r.shard == s) == list(range(sum(r.shard == s for r in docs)))
    keyed = spark.range(100_000).selectExpr("id * 11111111111 as _h", "id as _d", "id as _r", "1L as size")
    loose, exact = (sharding.find_boundaries(keyed, 8, 1, t, 8)[1] for t in (0.05, 0.0))
    assert loose < exact <= 12


def test_counts_below_probes_are_exact(spark):
    keyed = spark.range(5000).selectExpr("id % 97 as _h", "id % 11 as _d", "id as _r", "id % 7 + 1 as size")
    rows = sorted((int.from_bytes(bytes(sharding.key_bytes(*(np.array([x]) for x in (i % 97, i % 11, i)))[0]).ljust(24, b"\0"), "big"), i % 7 + 1) for i in range(5000))
    probes = [(5 << 128), rows[1234][0], rows[4000][0] + 1]
    cuts = [sum(k < p for k, _ in rows) for p in probes]
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 5000], strict=True)]
    assert sharding.histogram(keyed, probes) == [(sum(s for _, s in p), len(p), p[0][0], p[-1][0]) for p in parts]


def test_extra_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", "p"), (2, "bb", 6, "y", "q")], "doc_id long, text string, size int, shard string, `odd name` string")
    got = sharding.shard_by_bytes(docs, 2)
    assert got.columns == ["doc_id", "text", "odd name", "size", "law", "shard", "slot"]
    assert {(r.doc_id, r.text, r["odd name"], r.size) for r in got.collect()} == {(1, "a", "p", 2), (2, "bb", "q", 3)}


def test_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)]
    got = sharding.write_shards(frame(spark, rows), str(tmp_path / "shards"), 4)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == rows and got.select("shard").distinct().count() == 4


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_histogram_shards"](spark, folder).collect()
    assert result(QUERIES["op12_histogram_shards"](spark, folder)) == expected(rows)
    texts = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


def test_texts_go_to_their_shards(spark, monkeypatch):
    placed = []
    monkeypatch.setattr(sharding, "shard_by_bytes", lambda *a, real=sharding.shard_by_bytes, **b: placed.append(real(*a, **b)) or placed[-1])
    rows = odd_rows()
    got = sharding.shard_query(frame(spark, rows))
    assert result(got) == expected(rows)
    at = {(r.doc_id, r.shard, r.slot): r.text for r in placed[0].collect()}  # what lies in the shards
    assert {(r.doc_id, r.shard, r.slot): r.text_crc32 for r in got.collect()} == {k: zlib.crc32((t or "").encode()) for k, t in at.items()}
    assert sorted(t or "" for t in at.values()) == sorted(t or "" for _, t in rows)
