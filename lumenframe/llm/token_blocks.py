"""Token ids as patched frame-of-reference blocks.

Texts are range-partitioned by doc_id; one task writes one shard of blocks of ``BLOCK`` ids in doc_id order. A block
stores its smallest id (base), the ids less the base packed with ``width`` bits, and the few that need more bits in an
exception list (positions and values). The width is the one that holds ``PERCENTILE`` percent of the block's values.

The file format is a Parquet table with a row per block, so the files are committed by Spark on any store it can write to:
shard, block, start (index of the block's first id in its shard: the block index), count, base, width, packed, positions,
values, and the texts whose ids lie in the block: doc_id, begin (index of the text's first id in the shard), offset and
length inside the block. A block is decoded without any other, so reading needs no order and no shuffle of ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.alignment import byte_alphabet
from lumenframe.plans.storage import give_back, shared_folder

BLOCK = 2048
PERCENTILE = 90
END = 1  # the id appended to every text
SLICE = 2 << 20  # bytes of text encoded at a time
REMEMBERED = 24 << 20  # bytes of pieces and their ids that a task remembers
LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-įı-ɏ])([%*#$&!.,;:?)])"  # Latin letters whose lower case is one letter
WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
FOLDED = {ord(c): " " for c in "\n\t\r"} | {c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}
SCHEMA = (
    "shard int, block int, start long, count int, base long, width int, packed binary, positions binary, values binary, "
    "texts array<struct<doc_id: long, begin: long, offset: int, length: int>>"
)
_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("count", pa.int32()), ("base", pa.int64()), ("width", pa.int32()),
        ("packed", pa.binary()), ("positions", pa.binary()), ("values", pa.binary()),
        ("texts", pa.list_(pa.struct([("doc_id", pa.int64()), ("begin", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())]))),
    ]
)


def pack(ids: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
    """(base, width, packed, positions, values) of one block of uint32 ids."""
    base = int(ids.min())
    rest = (ids - np.uint32(base)).astype(np.uint32)
    width = int(np.partition(rest, k := (len(rest) * PERCENTILE - 1) // 100)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return base, width, np.packbits(bits, bitorder="little").tobytes(), over.astype("<u2").tobytes(), rest[over].astype("<u4").tobytes()


def unpack(count: int, base: int, width: int, packed: bytes, positions: bytes, values: bytes) -> np.ndarray:
    """The ids of a block as little-endian uint32."""
    at = np.arange(count, dtype=np.int64) * width
    padded = np.frombuffer(packed + bytes(8), np.uint8)
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the 64 bits from every byte on
    rest = ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")
    rest[np.frombuffer(positions, "<u2")] = np.frombuffer(values, "<u4")
    return (rest + np.uint32(base)).astype("<u4")


def _parts_at_spaces(tok) -> bool:
    """Whether the ids of a text are those of its pieces between white space, as probes of the vocabulary show."""
    probes = ["a b", "Ab, c.", "x\ny", "x\ty 12", "é \u0301a", "İ. ok", "don't  stop", " lead", "trail ", "\r\nq", "日本 語", "<|endoftext|> a", "ΑΣ ΑΣ", "Ab.c,.d", "o'clock.", "É!?"]

    def ids(text: str) -> list[int]:
        return tok.encode(text, add_special_tokens=False).ids

    return all(ids(p) == [i for piece in re.sub(LETTER_MARK, r"\1 \2", p.translate(FOLDED)).split(" ") for i in ids(piece)] for p in probes)


def word_ranks(tokenizer: str) -> dict[bytes, int] | None:
    """Ids of the vocabulary's byte strings, or None if the file is not of the kind that ``_merger`` is made for.

    For byte-level merges with a word end whose ids are in the order of the merges an id is a rank, and tiktoken merges a
    single word faster than the library makes an encoding of it. The word end is a byte that UTF-8 does not have.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, end, entries = byte_alphabet(), model.get("end_of_word_suffix"), model.get("vocab", {})
    if model.get("type") != "BPE" or not end or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    made = [entries["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    if made != list(range(512, 512 + len(made))):
        return None
    ranks = {}
    for entry, i in entries.items():
        body, last = (entry[: -len(end)], b"\xff") if entry.endswith(end) else (entry, b"")
        if i < 512 + len(made) and all(c in alphabet for c in body):
            ranks[bytes(alphabet[c] for c in body) + last] = i
    return ranks


def _merger(ranks: dict[bytes, int]):
    """A function from the UTF-8 bytes of a word and its end to the word's ids."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _encoder(tokenizer: str, ranks: dict[bytes, int] | None = None):
    """A function from an Arrow text column to (uint32 ids with the end ids, ids per text).

    A vocabulary that splits at white space and marks and drops the white space gives each piece between spaces its own ids: the pieces of some
    texts become a dictionary, its entries are encoded once, and the texts' ids are gathered by their codes. Entries are
    remembered up to ``REMEMBERED`` bytes while the task runs. Any other vocabulary encodes whole texts.
    """
    from array import array

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    tok = tokenizers.Tokenizer.from_file(tokenizer)
    known: dict[str, bytes] = {}
    held = 0
    merged = _merger(ranks) if ranks else None
    probes = ["a", "the", "zzzqx", "été", "naïveté", "ß", "ÿñ", "supercalifragilistic"]
    if merged and any(merged(w.encode() + b"\xff") != tok.encode(w, add_special_tokens=False).ids for w in probes):
        merged = None

    def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in tok.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
        return np.array([i for r in rows for i in (*r, END)], "<u4"), np.array([len(r) + 1 for r in rows], np.int64)

    def looked_up(pieces: list[str]) -> list[bytes]:
        nonlocal held
        new = [p for p in pieces if p not in known]
        if new:
            other = new
            if merged:  # a word of lower-case Latin letters is one piece for the vocabulary as it is
                words = list(filter(WORD, new))
                known.update((w, array("I", merged(w.encode() + b"\xff")).tobytes()) for w in words)
                other = [p for p in new if p not in known]
            known.update(zip(other, (array("I", e.ids).tobytes() for e in tok.encode_batch_fast(other, add_special_tokens=False)), strict=True))
            held += sum(map(len, new)) + sum(len(known[p]) for p in new) + 150 * len(new)
        out = [known[p] for p in pieces]
        if held > REMEMBERED:
            known.clear()
            held = 0
        return out

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for space in "\n\t\r":
            column = pc.replace_substring(column, space, " ")
        # fewer different pieces: the vocabulary parts marks from a letter and folds case; '<' may begin a special token
        column = pc.replace_substring_regex(column, LETTER_MARK, r"\1 \2")
        column = pc.if_else(pc.match_substring(column, "<"), column, pc.ascii_lower(column))
        split = pc.split_pattern(column, " ")
        coded = split.values.dictionary_encode()
        entries = looked_up(coded.dictionary.to_pylist())
        sizes = np.array([len(b) // 4 for b in entries], np.int64)
        flat = np.frombuffer(b"".join(entries), "<u4")
        codes, rows = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        length = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(length)])  # of the pieces among the texts' ids
        per_text = ends[rows[1:]] - ends[rows[:-1]]
        # where the ids of each piece go: one place further for every text before, for its end id
        out = np.full(int(ends[-1]) + len(column), END, "<u4")
        shift = np.repeat(np.arange(len(column)), np.diff(rows))
        start = (np.cumsum(sizes) - sizes)[codes]
        steps = np.arange(int(ends[-1])) - np.repeat(ends[:-1], length)
        out[np.repeat(ends[:-1] + shift, length) + steps] = flat[np.repeat(start, length) + steps]
        return out, per_text + 1

    return encode if _parts_at_spaces(tok) else whole


def _slices(column: pa.Array, most: int):
    """Consecutive slices of at most ``most`` bytes of text; a longer text stands alone."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8))
    low = 0
    while low < len(column):
        high = low + 1 + int(np.searchsorted(np.cumsum(sizes[low + 1 :]) + sizes[low], most, "right"))
        yield low, high
        low = high


def write_blocks(docs: DataFrame, path: str, tokenizer: str, parts: int) -> None:
    """Write the blocks of ``docs`` (doc_id, text). A null text is empty; null ids come first; equal ids follow in text order."""

    ranks = word_ranks(tokenizer)  # read once

    def run(batches):
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _encoder(tokenizer, ranks)
        held, texts, size, start, block = [], [], 0, 0, 0

        def rows(last: bool):
            """Blocks of the ids held; what does not fill a block stays unless it is the last."""
            nonlocal held, texts, size, start, block
            ids, out, at, first = np.concatenate(held), [], 0, 0
            while size - at >= BLOCK or (last and at < size):
                n = min(BLOCK, size - at)
                inside = []
                for i in range(first, len(texts)):
                    doc, begin, length = texts[i]
                    low, high = max(begin, start), min(begin + length, start + n)
                    if low >= start + n:
                        break
                    inside.append({"doc_id": doc, "begin": begin, "offset": low - start, "length": high - low})
                    first = i + (begin + length <= start + n)
                base, width, packed, positions, values = pack(ids[at : at + n])
                out.append(dict(shard=shard, block=block, start=start, count=n, base=base, width=width, packed=packed, positions=positions, values=values, texts=inside))
                at, start, block = at + n, start + n, block + 1
            held, texts, size = [ids[at:]], texts[first:], size - at
            return pa.RecordBatch.from_pylist(out, schema=_ARROW)

        done = 0
        for b in batches:
            doc, column = b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_string()).fill_null("")
            for low, high in _slices(column, SLICE) if len(doc) else ():
                ids, lengths = encode(column[low:high])
                held.append(ids)
                size += len(ids)
                for d, n in zip(doc[low:high], lengths.tolist(), strict=True):
                    texts.append((d, done, n))
                    done += n
                if size >= 64 * BLOCK:
                    yield rows(False)
        if size:
            yield rows(True)
        del encode, held, texts
        give_back()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def _times(matrix: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """The 32 by 32 bit matrix (a column per bit) times each crc."""
    out = np.zeros_like(crcs)
    for bit in range(32):
        out ^= np.where((crcs >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _zero_bytes() -> list[np.ndarray]:
    """Matrices that append 1, 2, 4 ... zero bytes to what a crc has read."""
    one_bit = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)
    out = [one_bit]
    for _ in range(3 + 40):
        out.append(_times(out[-1], out[-1]))
    return out[3:]


def join_crcs(crcs: list[list[int]], lengths: list[list[int]]) -> np.ndarray:
    """For each row, the crc32 of its parts' concatenation from the parts' own and their byte lengths."""
    zeros, out = _zero_bytes(), np.array([c[0] for c in crcs], np.uint32)
    for j in range(1, max(map(len, crcs), default=0)):
        rows = np.array([i for i, c in enumerate(crcs) if len(c) > j])
        length, moved = np.array([lengths[i][j] for i in rows], np.int64), out[rows]
        for k in range(int(length.max()).bit_length()):
            moved = np.where((length >> k) & 1, _times(zeros[k], moved), moved)
        out[rows] = moved ^ np.array([crcs[i][j] for i in rows], np.uint32)
    return out.astype(np.int64)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every text, from the files alone."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    sums = blocks.groupBy("shard").agg(F.sum("count").alias("ids"))  # a row per shard
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("shard_start"))

    def decode(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                raw = unpack(r["count"], r["base"], r["width"], r["packed"], r["positions"], r["values"]).tobytes()
                for t in r["texts"]:
                    part = raw[4 * t["offset"] : 4 * (t["offset"] + t["length"])]
                    out.append((r["shard"], t["begin"], t["doc_id"], r["block"], t["length"], zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "begin", "doc_id", "block", "length", "crc"])

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series(join_crcs([[x["crc"] for x in p] for p in parts], [[4 * x["length"] for x in p] for p in parts]))

    pieces = blocks.mapInArrow(decode, "shard int, begin long, doc_id long, block int, length int, crc long")
    texts = pieces.groupBy("shard", "begin").agg(F.first("doc_id").alias("doc_id"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "length", "crc"))).alias("parts"))
    return texts.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", joined("parts").alias("ids_crc32"))


def token_blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text; other columns are not read) and return doc_id, start, n_tokens, ids_crc32 as read back.

    Every row is a text, also an empty or null one (its end id alone), one with a null id (these come first) and one
    that repeats an id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/lumenframe/blocks-{spark.sql('select uuid()').first()[0]}"
    write_blocks(docs, path, tokenizer, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_digests(spark, path)
