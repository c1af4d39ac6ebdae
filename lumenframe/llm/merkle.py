"""Merkle manifest of a dataset as a tree of SHA-256 midstates.

A child is 64 hex digits, so it fills exactly one block of SHA-256: after i children the whole state of a parent's hash is
eight words. A parent keeps that state before each child slot; to fold a replaced child into the root, the state before its
slot is resumed with the replacement and its right siblings only. States of thousands of parents are advanced at once as
columns of words.

``GROUP`` leaves (three levels of 16) of a source form one row of the manifest; the levels above are built in the same way
from the tops, round by round, and give every group its outer path: per level the resumable state and the siblings. So a
task holds one group and the few levels above it, whatever the size of a source, and the rows of a source are never
gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.sharding import CRC_TABLE, crc_sql
from lumenframe.plans.joins import match
from lumenframe.plans.storage import materialize

FAN = 16
LEVELS = 3
GROUP = FAN**LEVELS
ROW_BITS = 33  # monotonically_increasing_id: partition in the upper bits, row in the lower
BATCH = 4  # groups of leaves whose states are advanced at once


def _roots(power: float, count: int, digits: int) -> list[int]:
    """First ``digits`` bits of the fractional parts of the roots of the first primes, as the standard defines its constants."""
    primes, n = [], 2
    while len(primes) < count:
        if all(n % p for p in primes):
            primes.append(n)
        n += 1
    k, out = round(1 / power), []
    for p in primes:
        low, high = 0, p << digits
        while low < high:  # integer k-th root of p * 2^(k * digits)
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**k <= p << (k * digits) else (low, mid - 1)
        out.append(low & ((1 << digits) - 1))
    return out


START = np.array(_roots(1 / 2, 8, 32), np.uint32)
ROUND = np.array(_roots(1 / 3, 64, 32), np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def advance(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (n, 8) after one more block (n or 1, 16 words) each."""
    w = [np.ascontiguousarray(blocks[:, i]) for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(states[:, i]) for i in range(8))
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (c & (a ^ b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def closing(children: np.ndarray) -> np.ndarray:
    """The last block of a message of so many children: padding and its length in bits."""
    out = np.zeros((len(children), 16), np.uint32)
    out[:, 0] = 0x80000000
    bits = children.astype(np.uint64) * np.uint64(512)
    out[:, 14], out[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return out


def child_blocks(digests: np.ndarray) -> np.ndarray:
    """The block of each digest (n, 8 words): its 64 hex digits."""
    raw = digests.astype(">u4").view(np.uint8).reshape(len(digests), 32)
    text = np.empty((len(digests), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def finish(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    return advance(states, closing(children))


def begin(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def words(raw: bytes | np.ndarray) -> np.ndarray:
    """Digests or states (n, 8) from their bytes."""
    return np.frombuffer(raw, ">u4").reshape(-1, 8).astype(np.uint32)


def raw(values: np.ndarray) -> bytes:
    return values.astype(">u4").tobytes()


def hexed(values: np.ndarray) -> list[str]:
    text = child_blocks(values).astype(">u4").tobytes().decode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


class Level:
    """One level over runs of consecutive nodes: digests of the parents and the state kept before each child slot.

    ``run``: ascending run number of every node, runs of at most ``FAN``.
    """

    def __init__(self, digests: np.ndarray, run: np.ndarray):
        self.first = np.flatnonzero(np.diff(run, prepend=-1))
        self.count = np.diff(np.append(self.first, len(run)))
        self.parent = np.repeat(np.arange(len(self.first)), self.count)
        self.slot = np.arange(len(run)) - self.first[self.parent]
        self.blocks = child_blocks(digests)
        self.before = np.empty((len(run), 8), np.uint32)
        states = begin(len(self.first))
        for s in range(int(self.count.max(initial=0))):
            has = self.count > s
            at = self.first[has] + s
            self.before[at] = states[has]
            states[has] = advance(states[has], self.blocks[at])
        self.digests = finish(states, self.count)

    def fold(self, digests: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Parents' digests when child ``node[i]`` has digest ``digests[i]``: the kept state is resumed from its slot on."""
        states = advance(self.before[node], child_blocks(digests))
        count, slot, first = self.count[self.parent[node]], self.slot[node], self.first[self.parent[node]]
        for s in range(1, int(count.max(initial=0))):
            on = (s > slot) & (s < count)
            if on.any():
                states[on] = advance(states[on], self.blocks[first[on] + s])
        return finish(states, count)

    def siblings(self, states: np.ndarray, sizes: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proof states and their numbers of children after the siblings of each node, left to right."""
        count, slot, first = self.count[self.parent[node]], self.slot[node], self.first[self.parent[node]]
        states = states.copy()
        for s in range(int(count.max(initial=0))):
            on = (s != slot) & (s < count)
            if on.any():
                states[on] = advance(states[on], self.blocks[first[on] + s])
        return states, sizes + count - 1


def climb(digests: np.ndarray, key: np.ndarray, index: np.ndarray, total: np.ndarray) -> list[tuple[Level, np.ndarray, np.ndarray]]:
    """Up to ``LEVELS`` levels over nodes sorted by (key, index) as (level, nodes it covers, node of each input node).

    ``total``: nodes of the key on this level in the whole tree; a key with a single node is done and climbs no further.
    """
    out, here = [], np.arange(len(key))  # the node each input node stands under
    for _ in range(LEVELS):
        open_ = np.flatnonzero(total > 1)
        if not len(open_):
            break
        step = np.ones(len(open_), bool)
        k, i = key[open_], index[open_] // FAN
        step[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        level = Level(digests[open_], np.cumsum(step))
        out.append((level, open_, here))
        # parents take the places of their first children, so the order by (key, index) stays
        stays = total <= 1
        place = np.empty(len(key), np.int64)
        heads = stays.copy()
        heads[open_[level.first]] = True
        number = np.cumsum(heads) - 1
        place[stays] = number[stays]
        place[open_] = number[open_[level.first]][level.parent]
        fresh = np.empty((int(heads.sum()), 8), np.uint32)
        fresh[number[stays]] = digests[stays]
        fresh[number[open_[level.first]]] = level.digests
        key, index, total = key[heads], np.where(total[heads] > 1, index[heads] // FAN, index[heads]), -(-total[heads] // FAN)
        digests, here = fresh, place[here]
    out.append((None, digests, here))
    return out


def _groups(batches, size: int) -> Iterator[dict[str, np.ndarray | list]]:
    """Whole groups of rows sorted by (key, index), some thousand rows at a time; a group is never torn."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        key, index = (table.column(n).to_numpy() for n in ("key", "index"))
        end = len(key) if last else int(np.flatnonzero((key != key[-1]) | (index // GROUP != index[-1] // GROUP))[-1:].sum() + 1) if len(key) and ((key[0] != key[-1]) | (index[0] // GROUP != index[-1] // GROUP)) else 0
        held[:] = table.slice(end).to_batches()
        return table.slice(0, end)

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= size * GROUP:
            out = cut(False)
            if out.num_rows:
                yield out
    if held:
        yield cut(True)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return words(b"".join(column.to_pylist()))


_TOPS = "key long, index long, digest binary, total long"
_PATH = "key long, index long, states array<binary>, runs array<binary>, slots array<int>"
_LEAVES = "key long, index long, digest binary, total long, doc_id array<long>, leaves binary, folded binary, proofs binary, sizes array<long>"


def _leaf_groups(batches) -> Iterator[pa.RecordBatch]:
    """One row per group: its top, and for every leaf what its folding and its proof have come to at the top."""
    for t in _groups(batches, BATCH):
        key, index, total = (t.column(n).to_numpy() for n in ("key", "index", "total"))
        leaf, changed = _digests(t.column("leaf")), _digests(t.column("changed"))
        levels = climb(leaf, key, index, total)
        folded, proofs, sizes = changed, begin(len(key)), np.zeros(len(key), np.int64)
        for level, open_, here in levels[:-1]:
            at = np.searchsorted(open_, here)
            on = (at < len(open_)) & (open_[np.minimum(at, len(open_) - 1)] == here)
            node = at[on]
            folded[on] = level.fold(folded[on], node)
            proofs[on], sizes[on] = level.siblings(proofs[on], sizes[on], node)
        _, tops, here = levels[-1]
        first = np.flatnonzero(np.diff(here, prepend=-1))
        last = np.append(first[1:], len(here))
        docs = t.column("doc_id").to_pylist()
        rows = [
            (int(key[a]), int(index[a]) // GROUP, raw(tops[here[a]][None]), -(-int(total[a]) // GROUP), docs[a:b], raw(leaf[a:b]), raw(folded[a:b]), raw(proofs[a:b]), sizes[a:b])
            for a, b in zip(first.tolist(), last.tolist(), strict=True)
        ]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = ["key", "index", "digest", "total", "doc_id", "leaves", "folded", "proofs", "sizes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _node_paths(batches) -> Iterator[pa.RecordBatch]:
    """For every node its path through up to ``LEVELS`` levels: state before its slot, the run's digests, its slot."""
    for t in _groups(batches, BATCH):
        key, index, total = (t.column(n).to_numpy() for n in ("key", "index", "total"))
        levels = climb(_digests(t.column("digest")), key, index, total)
        states, runs, slots = ([[] for _ in key] for _ in range(3))
        for level, open_, here in levels[:-1]:
            digests = words(b"".join(bytes.fromhex(x.astype(">u4").tobytes().decode()) for x in level.blocks))
            at = np.searchsorted(open_, here)
            for i in np.flatnonzero(at < len(open_)).tolist():
                node = at[i]
                if open_[node] == here[i]:
                    p = level.parent[node]
                    states[i].append(raw(level.before[node][None]))
                    runs[i].append(raw(digests[level.first[p] : level.first[p] + level.count[p]]))
                    slots[i].append(int(level.slot[node]))
        _, tops, here = levels[-1]
        cols = [key, index, states, runs, slots, [raw(tops[h][None]) for h in here]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "index", "states", "runs", "slots", "top"])


def _in_groups(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("key", F.expr(f"index div {GROUP}")).sortWithinPartitions("key", "index")


def outer_paths(tops: DataFrame) -> DataFrame:
    """(key, index, states, runs, slots, top): the path of every node to the single node of its key.

    Each round covers three levels, so the nodes become 4096 times fewer; the rounds end when every key has one node.
    """
    rounds, nodes = [], tops
    while (nodes.agg(F.max("total")).first()[0] or 0) > 1:
        paths = materialize(_in_groups(nodes).mapInArrow(_node_paths, _PATH + ", top binary"))
        rounds.append(paths)
        above = paths.groupBy("key", F.expr(f"index div {GROUP}").alias("index")).agg(F.first("top").alias("digest"))
        nodes = materialize(match(above, nodes.groupBy("key").agg(F.first(F.ceil(F.col("total") / GROUP)).alias("total")), ["key"]).select("key", "index", "digest", "total"))
    empty = [F.array().cast("array<binary>"), F.array().cast("array<binary>"), F.array().cast("array<int>")]
    out = nodes.select("key", "index", *[e.alias(n) for e, n in zip(empty, ("states", "runs", "slots"), strict=True)], F.col("digest").alias("top"))
    for paths in reversed(rounds):
        upper = out.select("key", F.col("index").alias("_up"), *[F.col(c).alias(f"_{c}") for c in ("states", "runs", "slots")], F.col("top").alias("_top"))
        lower = paths.withColumn("_up", F.expr(f"index div {GROUP}")).drop("top")
        joined = match(lower, upper, ["key", "_up"])
        out = materialize(joined.select("key", "index", *[F.concat(c, f"_{c}").alias(c) for c in ("states", "runs", "slots")], F.col("_top").alias("top")))
    return out


def _proofs(batches) -> Iterator[pa.RecordBatch]:
    """Rows of the result: every leaf of a group is folded along the group's outer path and its source's path."""
    for b in batches:
        for g in b.to_pylist():
            leaf, folded, proofs, sizes = words(g["leaves"]), words(g["folded"]), words(g["proofs"]), np.array(g["sizes"], np.int64)
            for state, run, slot in zip(g["states"], g["runs"], g["slots"], strict=True):
                blocks = child_blocks(words(run))
                folded = advance(np.repeat(words(state), len(folded), axis=0), child_blocks(folded))
                for s in range(slot + 1, len(blocks)):
                    folded = advance(folded, blocks[s : s + 1])
                folded = finish(folded, np.full(len(folded), len(blocks)))
                for s in range(len(blocks)):
                    if s != slot:
                        proofs = advance(proofs, blocks[s : s + 1])
                sizes = sizes + len(blocks) - 1
            n, root = len(leaf), g["root"].hex()
            back = hexed(folded)
            cols = [g["doc_id"], hexed(leaf), [g["subroot"].hex()] * n, [root] * n, hexed(finish(proofs, sizes)), back, [x == root for x in back]]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def leaf_text(values: list[Column]) -> Column:
    """What a leaf hashes: each value as its byte count, a colon and the value; a null as a hyphen."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)])


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with key (number of the source, null first) and index (place in the source), and (key, total) per source.

    Rows are range-partitioned by (source, doc_id, leaf, row number), so neither a hot source nor a repeated id is one task;
    places come from the counts of each partition's share of a source.
    """
    order = ["source", "doc_id", "leaf", "_row"]
    rows = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row")
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", ROW_BITS)))
    share = materialize(dealt.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("low")))
    sums = share.groupBy("source").agg(F.sum("n").alias("total"), F.min("_part").alias("_first"))
    # sources are numbered inside the partition where they begin, after the sources of the partitions before
    begun = sums.groupBy("_first").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    ahead = begun.select("_first", F.coalesce(F.sum("n").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    numbered = match(sums, ahead, ["_first"]).withColumn("key", F.col("_ahead") + F.row_number().over(W.partitionBy("_first").orderBy("source")) - 1)
    sources = materialize(numbered.select("source", "key", "total"))
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition the source lies in
    share = match(share.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))), sources, ["source"])
    offsets = materialize(share.select("source", "_part", "key", "total", (F.col("_before") - F.col("low")).alias("_shift")))
    placed = match(dealt, offsets, ["source", "_part"]).withColumn("index", F.col("_at") + F.col("_shift"))
    return placed.select("key", "index", "total", "doc_id", "leaf", "changed"), sources


def manifest(docs: DataFrame, values: list[Column], changed: list[Column], tampered: Column) -> DataFrame:
    """Tree of ``docs`` and the check of every row against it.

    A leaf is H of ``values`` (H: lower-case hex SHA-256); rows where ``tampered`` holds are folded with the leaf of
    ``changed`` instead. Needs doc_id and source; other columns are read only by the expressions. Per source the leaves ascend
    by doc_id (null first; rows that repeat an id by their leaf), every ``FAN`` consecutive nodes become their parent until one
    is left, and the sources' nodes, null first, then by bytes, in the same way give the root. Returns a row per input row:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A table of one row is its own root and its proof is the
    H of nothing. No rows give no rows.
    """
    leaf = F.sha2(leaf_text(values), 256)
    other = F.when(tampered, F.sha2(leaf_text(changed), 256)).otherwise(leaf)
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("changed")
    )
    placed, sources = placed_leaves(leaves)
    groups = materialize(_in_groups(placed).mapInArrow(_leaf_groups, _LEAVES))
    paths = outer_paths(groups.select("key", "index", "digest", "total"))
    subroots = paths.where("index = 0").select("key", F.col("top").alias("subroot"))
    many = sources.count()
    over = outer_paths(subroots.select(F.lit(0).cast("long").alias("key"), F.col("key").alias("index"), F.col("subroot").alias("digest"), F.lit(many).cast("long").alias("total")))
    over = over.select(F.col("index").alias("key"), *[F.col(c).alias(f"_{c}") for c in ("states", "runs", "slots")], F.col("top").alias("root"))
    whole = match(paths.withColumnRenamed("top", "subroot"), over, ["key"])
    whole = materialize(whole.select("key", "index", *[F.concat(c, f"_{c}").alias(c) for c in ("states", "runs", "slots")], "subroot", "root"))
    joined = match(groups, whole, ["key", "index"])
    return joined.select("doc_id", "leaves", "folded", "proofs", "sizes", "states", "runs", "slots", "subroot", "root").mapInArrow(
        _proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest_query(docs: DataFrame) -> DataFrame:
    """The manifest of documents; where 5 divides the crc32 of the decimal doc_id, the text is tampered to lower case."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*values[:-1], F.translate("text", UPPER, LOWER)]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(docs, values, changed, tampered)


def _manifest_sql(levels: int = 8) -> str:
    """The tree level by level, as chained tables; ``levels`` bound the rows to 16^8 a source."""

    def packed(v: str) -> str:
        return f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"

    head = " || ".join(packed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    sql = f"""
WITH steps AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_of),
d AS MATERIALIZED (
  SELECT doc_id, source, sha256({head} || {packed("text")}) AS leaf,
    CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({head} || {packed(f"translate(text, '{UPPER}', '{LOWER}')")})
      ELSE sha256({head} || {packed("text")}) END AS folded
  FROM documents, steps),
g AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM d),
f0 AS MATERIALIZED (
  SELECT doc_id, k, leaf, folded, '' AS proof, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM g),
n0 AS MATERIALIZED (SELECT k, i, leaf AS h, count(*) OVER (PARTITION BY k) AS m FROM f0)"""

    def climbed(nodes: str, rows: str, up: str, out: str, key: str) -> str:
        run = f"PARTITION BY {key}i // 16 ORDER BY i ROWS BETWEEN"
        return f""",
s{up} AS MATERIALIZED (
  SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {nodes}),
n{up} AS MATERIALIZED (
  SELECT DISTINCT {"k, " if key else ""}CASE WHEN m > 1 THEN i // 16 ELSE i END AS i, CASE WHEN m > 1 THEN sha256(l || h || r) ELSE h END AS h, (m + 15) // 16 AS m
  FROM s{up}),
f{up} AS MATERIALIZED (
  SELECT f.* REPLACE (CASE WHEN m > 1 THEN sha256(l || folded || r) ELSE folded END AS folded, CASE WHEN m > 1 THEN proof || l || r ELSE proof END AS proof,
    CASE WHEN m > 1 THEN f.{out} // 16 ELSE f.{out} END AS {out})
  FROM {rows} f JOIN s{up} s ON f.{out} = s.i{" AND f.k = s.k" if key else ""})"""

    for level in range(levels):
        sql += climbed(f"n{level}", f"f{level}", str(level + 1), "i", "k, ")
    sql += f""",
nt AS MATERIALIZED (SELECT k AS i, h, count(*) OVER () AS m FROM n{levels}),
ft AS MATERIALIZED (SELECT f.doc_id, f.leaf, f.folded, f.proof, f.k AS j, t.h AS subroot FROM f{levels} f JOIN nt t ON f.k = t.i)"""
    nodes, rows = "nt", "ft"
    for level in range(levels):
        sql += climbed(nodes, rows, f"_{level}", "j", "")
        nodes, rows = f"n_{level}", f"f_{level}"
    return sql + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM {rows}, {nodes}"""


MANIFEST_SQL = _manifest_sql()
