"""The Merkle manifest against a tree of whole hashes."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import merkle
from lumenframe.llm.queries import QUERIES

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, for every node the [(left siblings, right siblings)] up to it)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for p, w in zip(paths, where, strict=True):
            p.append((runs[w // 16][: w % 16], runs[w // 16][w % 16 + 1 :]))
        nodes, where = [sha("".join(r)) for r in runs], [w // 16 for w in where]
    return nodes[0], paths


def fold(leaf, path):
    for left, right in path:
        leaf = sha("".join([*left, leaf, *right]))
    return leaf


def plain(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, leaf_of(r)))
    subs, sources = {}, sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[s] = tree([leaf for _, leaf in by[s]])
    root, tops = tree([subs[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (r, leaf), path in zip(by[s], subs[s][1], strict=True):
            text = r[4].translate(lower) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            back = fold(leaf_of((*r[:4], text)), path + top)
            proof = sha("".join("".join([*a, *b]) for a, b in path + top))
            out.append((r[0], leaf, subs[s][0], root, proof, back, back == root))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(n, sources, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), None if (k := int(rng.integers(0, sources))) == 0 else f"s{k}", "en", 5, f"Text {i % 7} é") for i in rng.permutation(n)]


def test_constants_are_those_of_the_standard():
    assert [hex(x) for x in merkle.START[:2]] == ["0x6a09e667", "0xbb67ae85"] and hex(merkle.ROUND[0]) == "0x428a2f98" and hex(merkle.ROUND[63]) == "0xc67178f2"


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 100])
def test_levels_keep_states_that_fold_any_child(n):
    digests = [sha(str(i)) for i in range(n)]
    words = merkle.words(bytes.fromhex("".join(digests)))
    level = merkle.Level(words, np.arange(n) // 16)
    assert merkle.hexed(level.digests) == [sha("".join(digests[i : i + 16])) for i in range(0, n, 16)]
    folded = merkle.hexed(level.fold(words[::-1].copy(), np.arange(n)))
    for i in range(n):
        run = digests[i // 16 * 16 : i // 16 * 16 + 16]
        run[i % 16] = digests[n - 1 - i]
        assert folded[i] == sha("".join(run))
    proofs, sizes = level.siblings(merkle.begin(n), np.zeros(n, np.int64), np.arange(n))
    runs = [digests[i // 16 * 16 : i // 16 * 16 + 16] for i in range(n)]
    assert merkle.hexed(merkle.finish(proofs, sizes)) == [sha("".join(r[: i % 16] + r[i % 16 + 1 :])) for i, r in enumerate(runs)]


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (2, 1), (16, 1), (17, 1), (40, 40), (300, 18), (600, 2)])
def test_trees_against_whole_hashes(spark, n, sources):
    rows = make(n, sources, n)
    assert rows_of(merkle.manifest_query(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_small_groups_reach_through_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "GROUP", 16)
    rows = make(900, 3, 5) + [(5000 + i, f"only {i}", None, None, None) for i in range(40)]
    assert rows_of(merkle.manifest_query(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_a_source_of_more_than_one_group(spark):
    rows = [(i, "hot" if i % 9 else "b", "en", i, "A" * (i % 3)) for i in range(10_000)]
    got = rows_of(merkle.manifest_query(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (None, "a", "en", 3, "No id"), (None, "a", "en", 3, "No id"), (2, "", "", 0, ""), (3, "a", "de", 1, "Ünï \U0001f600"),
        (4, "A", "en", 1, "Twice"), (4, "A", "en", 1, "Twice"), (4, "A", "en", 1, "other text"), (5, "é", "fr", 9, "LONG " * 40_000), (-7, "a", None, None, "x"),
    ]
    docs = spark.createDataFrame([(*r, "clash", "root") for r in rows], SCHEMA + ", leaf string, index string")
    assert rows_of(merkle.manifest_query(docs)) == plain(rows)


def test_empty_table(spark):
    assert rows_of(merkle.manifest_query(spark.createDataFrame([], SCHEMA))) == []


def test_tampered_rows_fail_and_only_they(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("Text "), "id").alias("text"))
    got = merkle.manifest(docs, [F.col("text")], [F.lower("text")], F.col("doc_id") % 3 == 0).collect()
    assert all(r.verified == (r.doc_id % 3 != 0) and (r.folded_root == r.root) == r.verified for r in got)


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(QUERIES["op11_merkle_manifest"](spark, folder)) == plain(rows)
