"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification and components.

A text's set holds the distinct hashes of its 4-word shingles. Two sets of Jaccard similarity of at least t share at least
``t * n`` tokens of either, so under any order of all tokens their first ``q = n - ceil(t n) + r`` tokens share at least
``r``. ``r`` here is ``1 + n / 50``, which shuts out pairs that share a few chance shingles.

1. One scan finds heavy tokens: those in more than 1 of ``HEAVY`` texts, as pairs within blocks of texts tell. They come
   last in every order, so neither passages that many texts share nor chance shingles of common words enter a prefix, and
   the share of entries in long runs does not grow with the corpus. They are ``SMALL`` at most, the most frequent; any set of
   them gives the same links.
2. One scan gives every text's set size, set fingerprint and prefix under the first order. Equal sets become one node.
3. Prefix entries meet by token. Short runs give all their pairs; a pair stays if it shares ``r`` entries. Entries of long
   runs and of heavy tokens form stars around one node, in rounds, and are paired exhaustively only across components
   that are still apart, and only where what follows the shared token, with ``r - 1`` tokens of short runs before it, leaves room for the
   intersection that is needed. A near-copy group of any size costs edges in proportion to its nodes.
4. A candidate pair is first bounded by the parities of its sets' token counts in bins, two to four for a token: no more
   bins differ than the symmetric difference has tokens, and few less. Sets of too different sizes are no pair. Of the pairs left, the nodes' sets are read again;
   a pair must share ``r`` prefix tokens under each further order, and then have the exact intersection.

Nodes carry the smallest doc_id of equal sets. The set fingerprint has 128 bits, a token 64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm import bytetext as bt
from lumenframe.llm.components import components
from lumenframe.plans.storage import materialize

SEEDS = (0x1B873593CC9E2D51, 0x7F4A7C15F39CC060, 0x3C6EF372FE94F82B)
BLOCK = 2_000_000  # tokens counted together when looking for heavy ones
HEAVY = 50_000  # a token in more than 1 of so many texts is heavy
RUN = 48  # prefix entries of one token that are paired at once
STARS = 2  # star rounds before the exhaustive one
SMALL = 2_000_000  # ids that may be broadcast
TILE = 256  # nodes of one token in a tile
CELLS = 1 << 18  # words of bins of pairs that are compared at a time


def _needs(n, percent: int):
    """(prefix length, entries that two prefixes share at least) for sets of ``n`` tokens."""
    shared = 1 + n // 50
    return np.minimum(n, n - -(-percent * n // 100) + shared), shared


def _ordered(tokens: np.ndarray, heavy: np.ndarray, seed: int) -> np.ndarray:
    """Ranks of the tokens under one order: 63 bits of a seeded mix, the sign bit marks heavy tokens, which come last."""
    rank = bt.mix(tokens ^ np.uint64(seed)) >> np.uint64(1)
    if len(heavy):
        slot = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        rank |= (heavy[slot] == tokens).astype(np.uint64) << np.uint64(63)
    return rank


def _bins(rank: np.ndarray) -> bytes:
    """A bit per bin: whether an odd number of tokens falls into it by its low bits. A power of two of bins, 2 to 4 for a token."""
    many = max(64, 1 << (2 * len(rank) - 1).bit_length())
    odd = np.bincount((rank & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _folded(bins: bytes, words: int) -> np.ndarray:
    """The bins as 64-bit words, the finer ones folded onto ``words`` of them."""
    return np.bitwise_xor.reduce(np.frombuffer(bins, np.uint64).reshape(-1, words), axis=0)


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference; the finer bins are folded onto the coarser."""
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())


def _heavy_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens whose share of the texts, as pairs of texts of one block tell it, makes more than ``RUN`` and 1 of ``HEAVY``.

    A token of share ``p`` is expected in ``p * p * m * (m - 1)`` ordered pairs of ``m`` texts, so ``pairs / m`` over all
    blocks sums up to ``p * p * texts`` however rare the token is in one block. A block's equal sets count once.
    """

    def run(batches):
        def count(sets, texts):
            token, times = np.unique(np.concatenate(sets), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times * (times - 1) / texts)], ["token", "pairs"])

        held, texts, total = {}, 0, 0
        for b in batches:
            for w in bt.words(b.column("text")):
                for s in bt.shingles(w, size):
                    held[len(s), int(s.sum())] = s
                    texts += 1
                    total += len(s)
                    if total >= BLOCK:
                        yield count([*held.values()], texts)
                        held, texts, total = {}, 0, 0
        if held:
            yield count([*held.values()], texts)

    texts = docs.count()
    found = docs.select("text").mapInArrow(run, "token long, pairs double").groupBy("token").agg(F.sum("pairs").alias("pairs"))
    found = materialize(found.where(F.col("pairs") * texts > max(RUN, texts / HEAVY) ** 2))
    if (many := found.count()) > SMALL:
        found = found.where(F.col("pairs") > found.agg(F.percentile_approx("pairs", 1 - SMALL / many)).first()[0])
    rows = found.select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, size: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """doc_id, n, key (fingerprint of the set), prefix (ranks under the first order), bins (parities of token counts)."""

    def run(batches):
        for b in batches:
            n, key, prefix, bins = [], [], [], []
            for w in bt.words(b.column("text")):
                for s in bt.shingles(w, size):
                    rank = _ordered(s, heavy, SEEDS[0])
                    take = int(_needs(len(s), percent)[0])
                    n.append(len(s))
                    bins.append(_bins(rank))
                    key.append(np.array([bt.mix(s).sum(), bt.mix(s ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()], np.uint64).tobytes())
                    prefix.append(np.sort(np.partition(rank, take - 1)[:take] if take < len(rank) else rank).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
                ["doc_id", "n", "key", "prefix", "bins"],
            )

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, prefix array<long>, bins binary"))


def _runs(batches, percent: int):
    """Sorted (token, node, n, pos) rows: pairs of short runs as kind 0 (a, b, na, nb); rows of long runs as kind 1 (token, node, pos, n)."""
    rest = None

    def emit(token, node, n, pos):
        edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        length = np.diff(edge)
        out = []
        long = np.repeat(length > RUN, length)
        if long.any():
            out.append((np.ones(long.sum(), np.int64), token[long], node[long], pos[long], n[long]))
        for gap in range(1, min(RUN, int(length.max(initial=0)))):
            # rows whose run goes on for ``gap`` more rows
            i = np.flatnonzero(token[:-gap] == token[gap:])
            i = i[~long[i]]
            if not len(i):
                break
            x, y, nx, ny = node[i], node[i + gap], n[i], n[i + gap]
            ok = (x != y) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
            x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
            swap = x > y
            out.append((np.zeros(len(x), np.int64), np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["kind", "a", "b", "na", "nb"])

    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in ("token", "node", "n", "pos")]
        if rest is not None:
            rows = [np.concatenate(p) for p in zip(rest, rows, strict=True)]
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1])  # the last token may go on in the next batch
        yield from emit(*(r[:last] for r in rows)) if last else ()
        rest = [r[last:] for r in rows]
    if rest is not None:
        yield from emit(*rest)


def _of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``nodes`` that are among ``ids`` (node), where these are few; else all, for the join that follows finds them."""
    ids = materialize(ids.distinct())
    return nodes.join(F.broadcast(ids), "node", "left_semi") if ids.count() <= SMALL else nodes


def _across(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of nodes of different components that share a token, have room for the intersection and pass the bins.

    ``rows``: token, node, n, pos, root. Nodes of one token and of like set sizes are dealt into tiles of about ``TILE``, a
    component that fills tiles of its own apart from the others.

    If a token is the first of these that two sets share, the shared tokens before it are of short runs and fewer than ``r``
    (else the pair was formed there), so they and what follows the token bound the intersection.
    """
    # sets of like size are at most one band apart, or two by rounding
    rows = materialize(rows.withColumn("band", F.floor(F.log("n") / math.log(100 / min(percent, 95)))))
    sizes = rows.groupBy("token", "band", "root").agg(F.count("*").alias("k")).withColumn("own", F.when(F.col("k") > TILE, F.col("root")))
    parts = sizes.groupBy("token", "band", "own").agg(F.ceil(F.sum("k") / TILE).alias("parts"))
    sizes = sizes.alias("s").join(parts.alias("p"), (F.col("s.token") == F.col("p.token")) & (F.col("s.band") == F.col("p.band")) & F.col("s.own").eqNullSafe(F.col("p.own")))
    dealt = rows.join(sizes.select("s.token", "s.band", "root", "s.own", "parts"), ["token", "band", "root"]).join(_of(nodes, rows.select("node")).select("node", "bins"), "node")
    packed = dealt.groupBy("token", "band", "own", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")).agg(
        F.collect_list(F.struct("node", "root", "n", "pos", "bins")).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("n") - F.col("pos")).alias("room"), F.min("root").alias("low"), F.max("root").alias("high"),
    )
    tiles = materialize(packed.withColumn("tile", F.monotonically_increasing_id()))
    brief = tiles.drop("held", "own", "part")
    x, y = brief.alias("x"), brief.alias("y")
    fits = (100 + percent) * (F.least("x.room", "y.room") + F.floor(F.least("x.most", "y.most") / 50)) >= percent * (F.col("x.least") + F.col("y.least"))
    alike = (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
    apart = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high"))
    near = F.col("y.band").between(F.col("x.band") - 2, F.col("x.band") + 2)
    meet = materialize(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.tile") <= F.col("y.tile")) & near & fits & alike & apart).select(F.col("x.tile").alias("xt"), F.col("y.tile").alias("yt")))

    def side(name):
        return tiles.select(F.col("tile").alias(f"{name}t"), *[F.col(f"held.{c}").alias(name + c) for c in ("node", "root", "n", "pos", "bins")])

    def pairs(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = ({c: batch.column(s + c)[r].values.to_numpy() for c in ("node", "root", "n", "pos")} for s in "xy")
                bins = [batch.column(s + "bins")[r].as_py() for s in "xy"]
                nx, ny = x["n"][:, None], y["n"][None, :]
                both = np.minimum(nx - x["pos"][:, None], ny - y["pos"][None, :]) + np.minimum(nx, ny) // 50
                ok = (x["root"][:, None] != y["root"][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((100 + percent) * both >= percent * (nx + ny))
                if batch.column("xt")[r] == batch.column("yt")[r]:
                    ok &= x["node"][:, None] < y["node"][None, :]
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                words = min(map(len, bins[0] + bins[1])) // 8
                bx, by = (np.stack([_folded(h, words) for h in b]) for b in bins)
                stay = np.empty(len(i), bool)
                for at in range(0, len(i), step := max(1, CELLS // words)):
                    a, b = i[at : at + step], j[at : at + step]
                    differ = np.bitwise_count(bx[a] ^ by[b]).sum(axis=1, dtype=np.int64)
                    stay[at : at + step] = (100 + percent) * differ <= (100 - percent) * (x["n"][a] + y["n"][b])
                a, b = x["node"][i[stay]], y["node"][j[stay]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return meet.join(side("x"), "xt").join(side("y"), "yt").mapInArrow(pairs, "a long, b long").distinct()


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, tokens (sorted, 8 bytes each) of the given nodes."""

    def run(batches):
        for b in batches:
            tokens = [s.tobytes() for w in bt.words(b.column("text")) for s in bt.shingles(w, size)]
            yield pa.RecordBatch.from_arrays([b.column("node").cast(pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])

    nodes = materialize(nodes)
    if nodes.count() <= SMALL:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node")
    return materialize(texts.mapInArrow(run, "node long, tokens binary"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """The pairs (a, b) whose sets pass the bins, the further orders and the exact test; ``nodes`` has node, n, bins."""

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.array([_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True)], np.int64)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            near = ((100 + percent) * apart <= (100 - percent) * (na + nb)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])

    def exact(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                (px, rx), (py, ry) = _needs(len(x), percent), _needs(len(y), percent)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                if all(
                    len(np.intersect1d(np.sort(_ordered(x, heavy, s))[:px], np.sort(_ordered(y, heavy, s))[:py], True)) >= min(rx, ry) for s in SEEDS[1:]
                ):
                    both = len(np.intersect1d(x, y, True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    pairs = materialize(pairs)
    nodes = _of(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    low = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bins").alias("xa"))
    high = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("xb"))
    bounded = materialize(pairs.join(high, "b").join(low, "a").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a long, b long"))
    sets = _sets(docs, bounded.select(F.explode(F.array("a", "b")).alias("node")).distinct(), size)
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return materialize(bounded.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"))


def ngram_join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; other columns are not read).

    A text without words, or null, has an empty set and is linked with nothing. Rows with equal texts are linked. A null
    doc_id takes part in nothing and keeps a null component. Rows that repeat a doc_id each follow their own text.
    """
    docs = docs.select("doc_id", "text")
    heavy = _heavy_tokens(docs, size)
    rows = _prefixes(docs, size, percent, heavy)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("key", "n").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"), F.first("bins").alias("bins"))
    classes = materialize(classes)
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(entries.where("token >= 0").select("token", "node", "n", "pos").repartition(parts, "token").sortWithinPartitions("token").mapInArrow(lambda batches: _runs(batches, percent), "kind long, a long, b long, na long, nb long"))
    # short runs: pairs that share enough entries
    pairs = (
        met.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"))
        .where(F.col("shared") >= 1 + F.floor(F.least("na", "nb") / 50)).select("a", "b")
    )
    big = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("nb").alias("n"), F.col("na").alias("pos")).union(entries.where("token < 0").select("token", "node", "n", "pos"))
    # a node with few tokens of its own is near the middle of its copies: stars form around such nodes first
    big = materialize(big.withColumn("weight", F.count("*").over(W.partitionBy("node"))))
    nodes = classes.select("node", "n", "bins")
    links = _verified(pairs, nodes, docs, size, percent, heavy)
    roots = components(links)
    for turn in range(STARS + 1):
        here = big.join(roots, "node", "left").select(*big.columns, F.coalesce("root", "node").alias("root"))
        rank = F.xxhash64("node", F.lit(turn)) if turn else F.col("weight")
        apart = here.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max_by("node", F.struct(rank, "node")).alias("center")).where("low <> high")
        labelled = materialize(here.join(apart.select("token", "center"), "token"))
        if not labelled.take(1):
            break
        if turn < STARS:
            best = labelled.where("node <> center").groupBy("node", "center").count().groupBy("node").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
            new = best.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
        else:
            new = _across(labelled.select("token", "node", "n", "pos", "root"), nodes, percent)
        more = _verified(new, nodes, docs, size, percent, heavy)
        links = links.union(more)
        roots = components(links)
        big = labelled.drop("center", "root")
    names = rows.where("n > 0 and doc_id is not null").select("doc_id", "key", "n").join(classes.select("key", "n", "node"), ["key", "n"])
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return names.join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id")).union(alone)
