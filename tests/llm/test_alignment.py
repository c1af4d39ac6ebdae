"""Cross-tokenizer alignment against a token-by-token version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import alignment
from lumenframe.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_groups(x, y, a, b):
    """Groups of two id lists, one token at a time."""
    out, left, right, ea, eb, j = [], [], [], 0, 0, 0
    for i in x:
        left.append(i)
        ea += len(a.pieces[i])
        while eb < ea:
            right.append(y[j])
            eb += len(b.pieces[y[j]])
            j += 1
        if ea == eb:
            out.append((left, right))
            left, right = [], []
    return out


def plain(rows):
    """The whole result by loops over (doc_id, text)."""
    a, b = alignment.byte_level(A), alignment.sentence_pieces(B)
    grouped = []
    for _, text in rows:
        whole = (" " + text).encode() if text else b""
        x, y = (a.encode([text])[0], b.encode([text])[0]) if text else ([], [])
        same = text and b"".join(a.pieces[i] for i in x) == whole == b"".join(b.pieces[i] for i in y)
        grouped.append((x, y, plain_groups(x, y, a, b)) if same else ([], [], []))
    held, best = Counter(), defaultdict(int)
    for _, _, groups in grouped:
        held.update({(p, q) for left, right in groups for p in left for q in right})
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for (doc, _), (x, y, groups) in zip(rows, grouped, strict=True):
        links = [(p, q) for left, right in groups for p in left for q in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, len(x), len(y), len(groups), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), digest))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_texts():
    rng = np.random.default_rng(3)
    letters = "abc é中\U0001f600\n\t  .,'<>0x▁ßİ"
    noise = ["".join(rng.choice(list(letters), rng.integers(1, 60))) for _ in range(60)]
    return [
        None, "", " ", "  two spaces", "plain words here", "<|endoftext|> is plain text", "<s> </s> <unk> <0x0A>", "▁under", "tab\tand\nline\r\n",
        "日本語のテキスト", "\U0001f469‍\U0001f469‍\U0001f467", "a" * 3000, " " * 3000, "İstanbul İ. ok", "\x00\x01 control", "word " * 4000 + "end", *noise,
    ]


def test_cuts_are_the_common_ends():
    rng = np.random.default_rng(1)
    for t in range(2000):
        n = int(rng.integers(1, 60))
        a = np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9] if t % 3 == 0 else rng.integers(1, n + 1, rng.integers(0, n + 1)), n))
        _, i, j = np.intersect1d(a, b, return_indices=True)
        x, y = alignment.common_cuts(a, b)
        assert np.array_equal(x, i) and np.array_equal(y, j)


def test_ids_are_those_of_the_library():
    rng = np.random.default_rng(7)
    points = np.array([c for c in range(0x20000) if not 0xD800 <= c < 0xE000])
    texts = [f"a{chr(c)}b1{chr(c)} {chr(c)}.{chr(c)}" for c in points] + ["".join(map(chr, rng.choice(points, rng.integers(1, 60)))) for _ in range(3000)]
    texts += [t for t in odd_texts() if t]
    assert alignment.byte_level(A).encode(texts) == alignment.library_encoder(A)(texts)


def test_a_long_diagonal_costs_few_comparisons():
    ends = np.arange(1, 3_000_001)
    x, y = alignment.common_cuts(ends, ends)
    assert np.array_equal(x, y) and len(x) == 3_000_000


def test_odd_texts_against_a_plain_version(spark, monkeypatch):
    rows = list(enumerate(odd_texts())) + [(None, "no id"), (4, "plain words here"), (4, "plain words here")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, n_a string, pair string")
    assert rows_of(alignment.align_documents(docs, A, B)) == plain(rows)


def test_small_chunks_give_the_same_rows(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(odd_texts()) if t and len(t) < 3000]
    a, b = alignment.byte_level(A), alignment.sentence_pieces(B)
    whole = alignment.align_block([t for _, t in rows], a, b)
    parts = [alignment.align_block([t], a, b) for _, t in rows]
    assert np.array_equal(whole[0], np.concatenate([p[0] for p in parts])) and whole[1] == [d for p in parts for d in p[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(alignment.align_documents(docs, A, B)) == plain(rows)


def test_a_group_with_many_repeats_stays_small():
    a, b = alignment.byte_level(A), alignment.sentence_pieces(B)
    ka, kb = np.array([50_000]), np.array([40_000])
    doc, pair, times = alignment._links(np.zeros(50_000, np.int64), np.ones(40_000, np.int64), ka, kb, np.array([0]), len(a.pieces), len(b.pieces))
    assert (doc.tolist(), pair.tolist(), times.tolist()) == ([0], [1], [2_000_000_000])


def test_empty_table(spark):
    assert rows_of(alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_tokenizer_alignment"](spark, folder)) == plain(rows)


def test_links_are_summed_block_by_block_and_files_hold_few_chunks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(alignment, "materialize", lambda df, *a, real=alignment.materialize: made.append(real(df, *a)) or made[-1])
    monkeypatch.setattr(alignment, "CHUNK", 100)
    monkeypatch.setattr(alignment, "BLOCK", 100)
    docs = spark.createDataFrame([(i, f"the text number {i} and the text number {i} again " * 5) for i in range(60)], "doc_id long, text string").coalesce(1)
    got = alignment.align_documents(docs, A, B)
    assert got.count() == 60
    sizes = [r["count"] for r in made[0].groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) > 3 * alignment.FILED and max(sizes) <= alignment.FILED  # a reader holds the rows of a file at once
    doc, pair, times = alignment._summed(np.array([1, 0, 1, 1]), np.array([7, 9, 7, 8]), np.array([1, 2, 3, 4]))
    assert list(zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True)) == [(0, 9, 2), (1, 7, 4), (1, 8, 4)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
