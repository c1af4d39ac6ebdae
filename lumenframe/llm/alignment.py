"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes, so each gives an ascending array of end offsets. Where both arrays hold the same offset
a group ends. ``common_cuts`` walks the arrays along a diagonal (a fixed shift between the two indexes): slices of doubled
length are compared as they are, so one stretch of one-to-one tokens costs a few comparisons; where a slice differs, the
irregular group is merged token by token up to the next common offset, which gives the new shift.

Texts are handled in chunks of ``CHUNK`` bytes (a longer text stands alone), written as one row per chunk: the figures of
its texts, its distinct linked id pairs with the number of texts that hold them, and every text's links as places in that
list. So the corpus counts need one row per chunk and distinct pair, not one per text and pair, also for the pairs that
nearly all texts hold; every chunk then gets the counts of its own pairs back. Nothing grows with the corpus in one task.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.storage import give_back, materialize

BLOCK = 1 << 19  # bytes of text aligned at a time
CHUNK = 4 << 20  # bytes of text that share one list of pairs
FILED = 8  # chunks in a file: Spark's reader holds the rows of a file at once
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_CHUNKS = pa.schema(
    [
        ("chunk", pa.int64()), ("doc_id", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
        ("groups_sha256", pa.list_(pa.string())), ("first", _LONGS), ("at", _INTS), ("times", _LONGS), ("pairs", _LONGS), ("texts", _LONGS),
    ]
)
_SCHEMA = (
    "chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, first array<long>, at array<int>, times array<long>, pairs array<long>, texts array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The character a byte-level vocabulary writes for each byte: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Encodes texts and knows the bytes of every id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        names = [str(i) for i in range(len(pieces))]
        self.inner = np.array([n + "," for n in names], object)
        self.names = np.array(names, object)


#: how a byte-level vocabulary parts a text before it merges bytes; a fixed value of these vocabularies
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary in the tokenizers library's file; it sees a space before the text.

    Where the file's merges are in the order of their ids, as the usual ones are, an id is a rank and the merging is done
    by the faster tiktoken from the same file's entries; any other file is left to the tokenizers library.
    """
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, parts = file["model"], file.get("pre_tokenizer") or {}
    entries = model["vocab"]
    size = 1 + max([*entries.values(), *(t["id"] for t in file.get("added_tokens", []))])
    pieces = [b""] * size  # an added token never comes from a text, so its bytes do not matter
    for entry, i in entries.items():
        if all(c in alphabet for c in entry):
            pieces[i] = bytes(alphabet[c] for c in entry)
    made = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    ranked = made == list(range(made[0], made[0] + len(made))) and sorted(entries.values())[: made[0]] == list(range(made[0]))
    plain = parts.get("type") == "ByteLevel" and parts.get("use_regex") and not parts.get("add_prefix_space") and not file.get("normalizer")
    if ranked and plain and not model.get("ignore_merges"):
        import tiktoken

        enc = tiktoken.Encoding("byte_level", pat_str=PARTS, mergeable_ranks={p: i for i, p in enumerate(pieces) if p}, special_tokens={})
        return Vocabulary(lambda texts: [enc.encode_ordinary(" " + t) for t in texts], pieces)
    return Vocabulary(library_encoder(path), pieces)


def library_encoder(path: str):
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    tok = tokenizers.Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def sentence_pieces(path: str) -> Vocabulary:
    """A sentencepiece vocabulary, which puts the space before the text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Vocabulary(lambda texts: sp.encode(texts, num_threads=1), pieces)


def common_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the tokens of each side that end at a common offset; the two end arrays have the same last offset."""
    ea, eb = array("q", a.astype(np.int64).tobytes()), array("q", b.astype(np.int64).tobytes())
    raw_a, raw_b = ea.tobytes(), eb.tobytes()  # slices of bytes compare fastest
    n, i, j, known = len(ea), 0, 0, 0  # known: 1 if the tokens at i and j are known to end together
    at_a, at_b, length = array("q"), array("q"), array("q")
    add_a, add_b, add_length = at_a.append, at_b.append, length.append
    while i < n:
        x, y, left = 8 * (i + known), 8 * (j + known), 8 * (n - i - known)
        run, step = 0, 16
        while run < left and raw_a[x + run : x + run + step] == raw_b[y + run : y + run + step]:
            run += step
            step *= 2
        while step > 8 and run < left:  # how much of the last slice still agreed
            step >>= 1
            if raw_a[x + run : x + run + step] == raw_b[y + run : y + run + step]:
                run += step
        run = known + (min(run, left) >> 3)
        if run:
            add_a(i)
            add_b(j)
            add_length(run)
            i, j = i + run, j + run
        if i < n:  # an irregular group, up to the next common offset, which sets the new shift
            x, y = ea[i], eb[j]
            while x != y:
                if x < y:
                    i += 1
                    x = ea[i]
                else:
                    j += 1
                    y = eb[j]
            known = 1
    size = np.frombuffer(length, np.int64) if length else np.empty(0, np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return tuple(np.repeat(np.frombuffer(s, np.int64) if s else np.empty(0, np.int64), size) + inside for s in (at_a, at_b))


def _distinct(group: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, occurrences) of the distinct ids of each group, by group."""
    key, times = np.unique(group * width + ids, return_counts=True)
    return key // width, key % width, times


def _links(ids_a, ids_b, ka, kb, doc, width_a: int, width_b: int):
    """(text, pair, occurrences) of all links. ``ka``, ``kb``: tokens of each group; ``doc``: text of each group."""
    start_a, start_b = np.cumsum(ka) - ka, np.cumsum(kb) - kb
    one = (ka == 1) & (kb == 1)
    texts, pairs = [doc[one]], [ids_a[start_a[one]] * width_b + ids_b[start_b[one]]]
    times = [np.ones(int(one.sum()), np.int64)]
    odd = np.flatnonzero(~one)
    if len(odd):  # ids that a long group repeats meet once, with the product of their occurrences
        of_a, of_b = np.repeat(np.arange(len(ka)), ka), np.repeat(np.arange(len(kb)), kb)
        in_a, in_b = ~one[of_a], ~one[of_b]
        ga, xa, ta = _distinct(of_a[in_a], ids_a[in_a], width_a)
        gb, xb, tb = _distinct(of_b[in_b], ids_b[in_b], width_b)
        first, many = np.searchsorted(gb, odd), np.searchsorted(gb, odd, "right") - np.searchsorted(gb, odd)
        place = np.searchsorted(odd, ga)
        each = many[place]  # every distinct A id meets the distinct B ids of its group
        left = np.repeat(np.arange(len(ga)), each)
        right = np.repeat(first[place], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        texts.append(doc[ga[left]])
        pairs.append(xa[left] * width_b + xb[right])
        times.append(ta[left] * tb[right])
    return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)


def _written(ids_a, ids_b, ka, kb, a: Vocabulary, b: Vocabulary) -> np.ndarray:
    """The groups as text parts, in order: A ids, a bar, B ids, a semicolon."""
    out = np.empty(len(ids_a) + len(ids_b), object)
    end_a, end_b = np.cumsum(ka), np.cumsum(kb)
    place_a = np.arange(len(ids_a)) + np.repeat(end_b - kb, ka)
    place_b = np.arange(len(ids_b)) + np.repeat(end_a, kb)
    out[place_a], out[place_b] = a.inner[ids_a], b.inner[ids_b]
    out[place_a[end_a - 1]] = a.names[ids_a[end_a - 1]] + "|"
    out[place_b[end_b - 1]] = b.names[ids_b[end_b - 1]] + ";"
    return out


def align_block(texts: list[str | None], a: Vocabulary, b: Vocabulary):
    """Figures of each text (n_a, n_b, n_groups, n_links as columns), digests, and the links (text, pair, occurrences)."""
    figures, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    rows_a, rows_b, kept = [], [], []
    if some:
        given = [texts[i] for i in some]
        for i, x, y in zip(some, a.encode(given), b.encode(given), strict=True):
            whole = (" " + texts[i]).encode()
            if b"".join(map(a.pieces.__getitem__, x)) == whole and b"".join(map(b.pieces.__getitem__, y)) == whole:
                kept.append(i)
                rows_a.append(np.array(x, np.int64))
                rows_b.append(np.array(y, np.int64))
    if not kept:
        return figures, digests, (np.empty(0, np.int64),) * 3
    ids_a, ids_b = np.concatenate(rows_a), np.concatenate(rows_b)
    # the texts' bytes one after another: a text's end is an end on both sides
    cut_a, cut_b = common_cuts(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    ka, kb = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    n_a, n_b = np.array([len(r) for r in rows_a]), np.array([len(r) for r in rows_b])
    last = np.searchsorted(cut_a, np.cumsum(n_a) - 1)  # the group that ends each text
    groups = np.diff(last, prepend=-1)
    kept = np.array(kept)
    linked = np.add.reduceat(ka * kb, last + 1 - groups)
    figures[kept] = np.stack([n_a, n_b, groups, linked], axis=1)
    parts, end = _written(ids_a, ids_b, ka, kb, a, b), np.cumsum(n_a + n_b)
    for i, low, high in zip(kept, end - n_a - n_b, end, strict=True):
        digests[i] = hashlib.sha256("".join(parts[low:high])[:-1].encode()).hexdigest()
    return figures, digests, _links(ids_a, ids_b, ka, kb, np.repeat(kept, groups), len(a.pieces), len(b.pieces))


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, occurrences) with every pair of a text once, by text and pair. A text lies in one block, so this holds for its chunk."""
    pairs, at = np.unique(pair, return_inverse=True)
    key, place = np.unique(doc * len(pairs) + at, return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, place, times)
    many = max(1, len(pairs))
    return key // many, pairs[key % many], sums


def _chunk_row(chunk: int, docs: list, blocks: list) -> pa.RecordBatch:
    """One row for the texts of some blocks, whose links are summed."""
    figures = np.concatenate([f for f, _, _ in blocks])
    before = np.cumsum([0, *(len(d) for _, d, _ in blocks)])
    owner = np.concatenate([t + n for (_, _, (t, _, _)), n in zip(blocks, before, strict=False)])
    pairs, at = np.unique(np.concatenate([p for _, _, (_, p, _) in blocks]), return_inverse=True)
    sums = np.concatenate([k for _, _, (_, _, k) in blocks])
    held = np.bincount(at, minlength=len(pairs))
    row = [
        docs, *figures.T, [d for _, ds, _ in blocks for d in ds], np.searchsorted(owner, np.arange(len(docs) + 1)), at.astype(np.int32), sums, pairs, held.astype(np.int64),
    ]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[pa.array([x], t) for x, t in zip(row, _CHUNKS.types[1:], strict=True)]], schema=_CHUNKS)


def _chunks(batches, a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    a, b = byte_level(a_path), sentence_pieces(b_path)
    chunk = TaskContext.get().partitionId() << 32
    docs, blocks, weight = [], [], 0
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string())
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.empty(0, np.int64)
        low = 0
        while low < len(ids):
            high = low + 1 + int(np.searchsorted(np.cumsum(sizes[low + 1 :]) + sizes[low], BLOCK, "right"))
            docs += ids[low:high]
            figures, digests, links = align_block(column[low:high].to_pylist(), a, b)
            blocks.append((figures, digests, _summed(*links)))
            weight += int(sizes[low:high].sum())
            low = high
            if weight >= CHUNK:
                yield _chunk_row(chunk, docs, blocks)
                chunk, docs, blocks, weight = chunk + 1, [], [], 0
    if docs:
        yield _chunk_row(chunk, docs, blocks)
    give_back()


def _totals(own: pa.Table, known: pa.Table) -> pa.Table:
    """A row per text from its chunk's row and the corpus counts of the chunk's pairs, which lie at their ``place``."""
    row = {n: own.column(n)[0] for n in own.schema.names}
    at, times, first = (row[n].values.to_numpy(zero_copy_only=False) for n in ("at", "times", "first"))
    place, sums = known.column("place").to_numpy(), []
    for name in ("best", "count"):
        of = np.zeros(known.num_rows, np.int64)
        of[place] = known.column(name).to_numpy()
        total = np.concatenate([[0], np.cumsum(of[at] * times)]).astype(np.int64)
        sums.append(pa.array(total[first[1:]] - total[first[:-1]]))
    columns = [*(row[n].values for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, row["groups_sha256"].values]
    return pa.Table.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Align the tokens of two vocabularies over ``docs`` (doc_id, text; other columns are not read).

    ``a_path``: a byte-level vocabulary of the tokenizers library; ``b_path``: a sentencepiece model. Returns a row per
    input row: doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens in one group), n_best (links whose pair is
    held by most texts among the pairs of its A id, ties included), count_sum (over the links, how many texts hold their
    pair) and groups_sha256. A null or empty text, and one that a vocabulary does not give back byte by byte, has zeros
    and ''. Rows that repeat an id or a text, or have a null id, are texts of their own. No rows give no rows.
    """
    wide = len(sentence_pieces(b_path).pieces)
    chunks = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: _chunks(batches, a_path, b_path), _SCHEMA),
        FILED,
    )
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "p")).select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    counts = held.groupBy("pair").agg(F.sum("texts").alias("count")).withColumn("id_a", F.expr(f"pair div {wide}"))
    counts = materialize(counts)
    top = counts.groupBy("id_a").agg(F.max("count").alias("top"))  # a row per id of A at most
    marked = counts.join(top, "id_a").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    known = held.join(marked, "pair").select(F.col("chunk").alias("_chunk"), "place", "count", "best")
    # a chunk's counts meet its row in Python, one chunk at a time
    return chunks.drop("pairs", "texts").groupBy("chunk").cogroup(known.groupBy("_chunk")).applyInArrow(_totals, _RESULT)
