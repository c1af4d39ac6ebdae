"""The pipeline's stages on the smallest tables, each against what its operator or a plain version says of its own input."""

import re
import zlib

import numpy as np

import corpus_pipeline as P
from lumenframe.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, FOLDER)
        if i < len(P.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        seen.append((docs.toPandas(), (docs := spark.read.parquet(str(tmp_path / str(i)))).toPandas()))
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_blocks"]

    # filtering stages keep rows as they are
    for before, after in seen[:3]:
        kept = before[before["doc_id"].isin(after["doc_id"])].sort_values("doc_id").reset_index(drop=True)
        assert kept.equals(after.sort_values("doc_id").reset_index(drop=True)) and 0 < len(after) <= len(before)

    # near copies: by brute force, the smallest id of every linked group stays
    before, after = seen[1]
    sets = {}
    for doc, text in zip(before["doc_id"], before["text"], strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[doc] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert set(after["doc_id"]) == {d for d in ids if find(d) == d}

    # leaks: texts with a whole benchmark item go
    before, after = seen[2]
    items = [" ".join(t.lower().split()) for t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").toPandas()["text"]]
    leaky = {d for d, t in zip(before["doc_id"], before["text"], strict=True) if any(f" {x} " in f" {' '.join((t or '').lower().split())} " for x in items)}
    assert leaky and not leaky & set(after["doc_id"])

    # the mix keeps the words of its input, about
    before, after = seen[3]
    words = lambda t: len((t or "").split())
    assert abs(after["text"].map(words).sum() / before["text"].map(words).sum() - 1) < 0.15
    assert after.groupby("doc_id").size().max() <= 3

    # token blocks read back what the tokenizer gives
    before, after = seen[4]
    tok, at, want = Tokenizer.from_file(vocabulary()), 0, []
    for doc, text in before.sort_values(["doc_id", "text"])[["doc_id", "text"]].itertuples(index=False):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(after[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None), key=lambda r: r[1]) == want
