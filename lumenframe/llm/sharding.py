"""Shards of equal bytes by histogram sort.

Rows are ordered by (digest of the text, doc_id, row number), so copies of a text lie side by side. The boundaries between
shards are found without moving a row: each round deals candidate keys over the open intervals, every partition counts the
exact bytes and rows between them, and the counts close the intervals in on the targets until each boundary meets its
tolerance. A round also reports the smallest and largest key of each interval, so an interval that one text fills narrows to
that text's doc_ids at once. Then rows are exchanged once, to parts of a shard whose offsets the counts have given already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

DIGITS = 15  # of the text's sha256 that order the rows: 60 bits, a positive long
PART_TOLERANCE = 0.25  # of a part: parts inside a shard only share out the work
_WORD, _SHIFT = 1 << 64, 1 << 63  # doc_ids are shifted to be positive
END = 1 << 192
RESERVED = ("size", "law", "shard", "slot")
_COUNTS = "bucket int, bytes long, rows long, low binary, high binary"


def key_bytes(h: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes whose byte order is the order of (h, d, r)."""
    out = np.empty((len(h), 3), ">u8")
    out[:, 0], out[:, 1], out[:, 2] = h, d.astype(np.int64).view(np.uint64) ^ np.uint64(_SHIFT), r
    return out.view("S24").ravel()


def _pack(keys: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(k.to_bytes(24, "big") for k in keys), "S24") if keys else np.empty(0, "S24")


def buckets(probes: np.ndarray, h: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key. The digest alone decides for all but the keys that share one with a probe."""
    words = np.frombuffer(probes.tobytes(), ">u8").reshape(-1, 3)[:, 0].astype(np.int64)
    out = np.searchsorted(words, h, "left")
    tied = np.flatnonzero(np.searchsorted(words, h, "right") > out)
    if len(tied):
        out[tied] = np.searchsorted(probes, key_bytes(h[tied], d[tied], r[tied]), "right")
    return out


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _counted(batches, probes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact bytes, rows, smallest and largest key between the probes, once per partition."""
    found: dict[int, list] = {}
    for b in batches:
        h, d, r, size = _numbers(b, "_h", "_d", "_r", "size")
        if not len(h):
            continue
        order = np.lexsort((r, d, h))
        h, d, r, size = h[order], d[order], r[order], size[order]
        at = buckets(probes, h, d, r)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        low, high = key_bytes(h[first], d[first], r[first]), key_bytes(h[last], d[last], r[last])
        for i, n, k, x, y in zip(at[first].tolist(), np.add.reduceat(size, first).tolist(), (last - first + 1).tolist(), low, high, strict=True):
            x, y = bytes(x).ljust(24, b"\0"), bytes(y).ljust(24, b"\0")
            have = found.setdefault(i, [0, 0, x, y])
            have[:] = have[0] + n, have[1] + k, min(have[2], x), max(have[3], y)
    columns = list(zip(*[(i, *v) for i, v in found.items()], strict=True)) or [[]] * 5
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "bytes", "rows", "low", "high"])


def histogram(keyed: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """(bytes, rows, smallest key, largest key) below the first probe, between probes, and from the last on."""
    packed = _pack(probes)
    parts = keyed.select("_h", "_d", "_r", "size").mapInArrow(lambda batches: _counted(batches, packed), _COUNTS)
    sums = parts.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for x in sums.collect():  # a row per probe at most
        out[x.bucket] = (x.bytes, x.rows, int.from_bytes(x.low, "big"), int.from_bytes(x.high, "big"))
    return out


@dataclass
class Boundary:
    """The search for the first key with ``target`` bytes before it, or one within ``slack`` bytes of that."""

    target: Fraction
    slack: float
    low: int = 0  # fewer bytes lie before this key
    low_count: tuple[int, int] = (0, 0)
    high: int = END  # enough bytes lie before this key
    high_count: tuple[int, int] = (0, 0)
    inside: tuple[int, int] = (0, 1 << (4 * DIGITS + 128))  # smallest and largest key in between
    done: bool = False

    def settle(self, key: int, count: tuple[int, int]) -> None:
        self.high, self.high_count, self.done = key, count, True

    def see(self, key: int, count: tuple[int, int]) -> None:
        """A key with so many bytes and rows before it."""
        if self.done:
            return
        if self.slack and abs(count[0] - self.target) <= self.slack:
            self.settle(key, count)
        elif count[0] >= self.target:
            if key < self.high:
                self.high, self.high_count = key, count
        elif key > self.low:
            self.low, self.low_count = key, count


def _grid(low: int, high: int, n: int) -> set[int]:
    """Up to ``n`` keys above ``low`` and not above ``high``, at the start of a text's copies, or of a doc_id's, where these differ."""
    out = {low + (high - low) * i // n for i in range(1, n + 1)}
    for unit in (_WORD * _WORD, _WORD):
        if high // unit > low // unit:
            return {max(k // unit, low // unit + 1) * unit for k in out}
    return out - {low}


def find_boundaries(keyed: DataFrame, shards: int, parts: int, tolerance: float, probes: int) -> tuple[list[Boundary], int]:
    """The ``shards * parts - 1`` boundaries in order, and the rounds it took. Every ``parts``-th one parts two shards."""
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    many = shards * parts
    open_ = [
        Boundary(Fraction(total * t, many), total / shards * tolerance if t % parts == 0 else total / many * PART_TOLERANCE, high_count=(total, rows))
        for t in range(1, many)
    ]
    out, rounds = list(open_), 0
    while open_ and rows:
        asked: dict[tuple[int, int], int] = {}
        for b in open_:
            asked[b.inside] = asked.get(b.inside, 0) + probes
        keys = set().union(*(_grid(*span, n) for span, n in asked.items()), *({b.low, b.high} - {0, END} for b in open_))
        keys = sorted(keys)
        counts, below = histogram(keyed, keys), [(0, 0)]
        for n, k, _, _ in counts:
            below.append((below[-1][0] + n, below[-1][1] + k))
        spans = dict(zip([0, *keys], counts, strict=True))
        for key, count in zip(keys, below[1:], strict=False):
            for b in open_:
                if not b.done:
                    b.see(key, count)
        for b in open_:
            n = spans[b.low]  # no probe lies between low and high
            if not b.done:
                b.inside = n[2:]
                if n[1] <= 1 or n[2] == n[3]:  # a single row, or none: it begins before the target
                    b.settle(b.high, b.high_count)
        open_, rounds = [b for b in open_ if not b.done], rounds + 1
    return out, rounds


def _assigned(batches, edges: np.ndarray, shard_of: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row with its shard, its part and the rows of its shard before the part."""
    for b in batches:
        part = buckets(edges, *_numbers(b, "_h", "_d", "_r"))
        more = [pa.array(shard_of[part].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(start[part])]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "shard", "_part", "_start"])


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.0, probes: int = 32, carry: list[str] | None = None) -> DataFrame:
    """Put all rows of ``docs`` (doc_id, text) into ``shards`` of near equal bytes.

    Returns doc_id, ``carry`` (default: all other columns; one named as a result column is left out), and size (UTF-8 bytes
    of the text and 1; a null text counts as empty), law ('bytes'), shard, slot (gapless from 0 within a shard, in the order
    of the shard's rows). Rows are ordered by (digest of the text, doc_id with null first); a boundary is the first row with
    its share of all bytes before it, or with a ``tolerance`` (share of a shard) the first key found within that, which is
    where a text's copies begin if there is one. Rows equal in both are apart only by their place in the input and may be
    parted by a boundary. Fewer rows than shards leave shards empty; no rows give no rows.
    """
    spark = docs.sparkSession
    named = [c for c in (docs.columns if carry is None else carry) if c.lower() not in {"doc_id", "_h", "_d", "_r", *RESERVED}]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.col(f"`{c}`") for c in named],
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("long").alias("_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-_SHIFT)).alias("_d"),
    )
    keyed = materialize(keyed.withColumn("_r", F.monotonically_increasing_id()))
    parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    found, _ = find_boundaries(keyed, shards, parts, tolerance, probes)
    edges, before = [0, *(b.high for b in found)], [0, *(b.high_count[1] for b in found)]
    shard_of = np.arange(shards * parts) // parts
    start = np.array(before) - np.array(before)[shard_of * parts]
    packed = _pack([min(e, END - 1) for e in edges[1:]])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), "shard int, _part int, _start long"])
    dealt = keyed.mapInArrow(lambda batches: _assigned(batches, packed, shard_of, start), schema).repartitionById(shards * parts, "_part")
    within = F.row_number().over(W.partitionBy("_part").orderBy("_h", "_d", "_r")) - 1
    return dealt.select("doc_id", *[F.col(f"`{c}`") for c in named], "size", F.lit("bytes").alias("law"), "shard", (F.col("_start") + within).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """Write all columns as a folder of Parquet files per shard, rows by slot, and return what was written."""
    placed = shard_by_bytes(docs, shards, tolerance)
    placed.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def shard_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The texts go to their shards with their rows, and the crc32 is that of the text that has come there. ``grown_shard`` is null
    under this law, as in the SQL twin.
    """
    placed = shard_by_bytes(docs.select("doc_id", "text"), carry=["text"])
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: crc32 in SQL: the table of the 256 byte steps from its rule, then one step per byte of the text
CRC_TABLE = (
    "(SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(i)))"
)


def crc_sql(text: str) -> str:
    """The unsigned crc32 of a string expression, beside a column ``crc_of`` that holds ``CRC_TABLE``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, list_extract(crc_of, 1 + (xor(c, x) & 255)))))"


SHARD_SQL = f"""
WITH steps AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_of),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
    substr(sha256(coalesce(text, '')), 1, {DIGITS}) AS h
  FROM documents, steps),
placed AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized),
sharded AS (SELECT *, (before * 8 // total)::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM sharded"""
