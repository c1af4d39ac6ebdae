"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some positions of a window of consecutive words and ignores the others; the looked-at words are hashed
together. Two windows that differ only at ignored positions have equal hashes, so a hit survives substitutions there.
Masks are fixed and differ in what they ignore. Benchmark windows and training windows meet in an equi-join on the hash;
a hit fixes an alignment, and the whole item is then compared with the text along it, word by word.

The three heavy masks alone miss patterns of substitutions, so lighter seeds make the search complete. An item of n words
with at most k substitutions is split into blocks (of 4 words for 80 percent, two interleaved over 8), of which more than k exist: one is untouched.
Short items with too few blocks get masks that leave out any k of their words or groups of words. A stretch that scores ``passage``
holds some run of equal words (5 for 80 percent), and every run of that length is a seed.

Only DataFrame functions are used. The words of a text are hashed once; windows are generated, hashed and probed in one
generated loop against the benchmark's hashes; only the distinct alignments leave it. They are gathered by text, and the few texts
that have any are read again for the comparison. The benchmark side is broadcast when its hashes
number at most ``SMALL``; a larger one is joined by shuffle. Words are compared as 64-bit hashes of their lower-case form.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

#: offsets that a mask looks at; each spans 12 words or fewer and ignores three or more, so any two of them
#: differ in what a substitution may touch
MASKS = ((0, 1, 2, 4, 5, 8, 9, 11), (0, 2, 3, 5, 7, 8, 10, 11), (0, 1, 3, 4, 6, 7, 9, 10))
SMALL = 1_000_000  # benchmark window hashes that may be broadcast
FEW = 50_000  # alignments that may be broadcast to the texts that have them


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words; null and blank texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _split(percent: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """Words of a block, the mask of a block that is interleaved with another, and that of a block by itself."""
    block = max(1, percent // (100 - percent))
    return block, tuple(range(0, 2 * block, 2)), tuple(range(block))


def _left_out(n: int, percent: int) -> list[tuple[int, ...]]:
    """What an item of ``n`` words needs when its blocks are too few: masks that look at all but some ``k`` words or groups of
    words each, where ``k`` substitutions are allowed. Words that lie outside a text count as substituted."""
    k = n - -(-percent * n // 100)
    if n // _split(percent)[0] > k:
        return []
    # groups of words of about equal size, any ``k`` of them left out; single words where that is few masks
    many = n if k <= 1 else min(n, k + 2)
    groups = [range(i * n // many, (i + 1) * n // many) for i in range(many)]
    return [tuple(o for g in kept for o in g) for kept in combinations(groups, many - k)]


def _seed(mask: tuple[int, ...], at: Column) -> Column:
    return F.xxhash64(F.lit(",".join(map(str, mask))), *[F.get("h", at + o) for o in mask])


def _windows(words: DataFrame, key: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """One row per position and mask: at (from 0) and seed, the hash of the mask and the words it looks at.

    Past the end of the text a mask sees fewer words; such a seed can only cause a hit that the comparison refuses.
    """
    at = words.select(key, "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)))).alias("at"))
    return at.select(key, "at", F.explode(F.array(*[_seed(mask, F.col("at")) for mask in masks])).alias("seed"))


def _item_seeds(items: DataFrame, percent: int, run: int) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """item_id, item_at, seed of the items, and the masks, each starting at 0."""
    block, pair, row = _split(percent)
    n, upto = F.size("h"), lambda last, step=1: F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step)))
    even = (n - n % (2 * block)).cast("int")
    places = [(mask, upto(n - 1 - mask[-1])) for mask in (*MASKS, tuple(range(run)))]
    places.append((pair, F.flatten(F.transform(upto(even - 2 * block, 2 * block), lambda i: F.array(i, i + 1)))))
    places.append((row, F.when(n - even >= block, F.array(even))))
    # lengths with too few blocks are few, whatever the benchmark (7 for 80 percent)
    for length in sorted(r[0] for r in items.where(n < 200 * block).select(n).distinct().collect()):
        for seen in _left_out(length, percent):
            places.append((tuple(o - seen[0] for o in seen), F.when(n == length, F.array(F.lit(seen[0])))))
    masks = list(dict.fromkeys(mask for mask, _ in places))
    seeded = lambda mask: lambda i: F.struct(i.alias("item_at"), _seed(mask, i).alias("seed"))
    at = [F.transform(where, seeded(mask)) for mask, where in places]
    none = F.array().cast("array<struct<item_at:int,seed:bigint>>")
    return materialize(items.select("item_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in at]))).alias("s")).select("item_id", "s.*")), masks


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 80, passage: int = 13, shortest: int = 5) -> DataFrame:
    """One row per (doc_id, item_id) in which the text holds the item: the most equal words
    on an alignment (matched) of item_words, the score of the best stretch, and where the item starts on the first such alignment.

    A pair is reported when, along some alignment, at least ``percent`` of the item's words are equal, or
    some stretch scores ``passage``: the number of equal words less, for every substitution, what makes ``percent`` break
    even (4 words for 80). So a passage of 13 words of an item is enough, or one of 18 words with one substitution. The
    seeds miss no such alignment. Insertions and deletions break an alignment; substitutions do not. Items with fewer than ``shortest`` words are never reported. Rows of ``docs`` or ``benchmark`` with a null id are ignored; null and empty texts hold nothing.
    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are not read.
    """
    texts = docs.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("h"))
    items = benchmark.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") >= shortest).distinct()
    # best stretch: a match counts 1, a mismatch as much as makes ``percent`` break even
    cost = -(percent // (100 - percent))
    # runs of equal words between a stretch's mismatches are longer than a mismatch costs on average
    seeds, masks = _item_seeds(items, percent, max(1, min(passage, 1 - cost)))
    small = seeds.count() <= SMALL
    # narrow rows only: generating, probing and making distinct stay in one generated loop that copies no word arrays
    hits = _windows(texts, "doc_id", masks).join(F.broadcast(seeds) if small else seeds, "seed")
    hits = materialize(hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct())
    held = hits.join(items.withColumnRenamed("h", "item"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "item")).alias("hits"))
    held = F.broadcast(held) if hits.count() <= FEW else held
    again = docs.where("doc_id is not null").select("doc_id", "text").join(held, "doc_id").select("doc_id", "hits", word_hashes(F.col("text")).alias("h"))

    def compared(hit):
        start, n = hit["start"], F.size(hit["item"])  # where the item begins in the text; may lie before the text
        first = F.greatest(start, F.lit(0))
        here = F.slice("h", first + 1, F.greatest(F.least(n, F.size("h") - first), F.lit(0)))
        equal = F.zip_with(here, F.slice(hit["item"], first - start + 1, n), lambda a, b: F.when(a == b, 1).otherwise(cost))
        grown = lambda acc, e: F.struct(
            (acc["matched"] + F.when(e == 1, 1).otherwise(0)).alias("matched"), F.greatest(acc["now"] + e, F.lit(0)).alias("now"), F.greatest(acc["best"], acc["now"] + e).alias("best")
        )
        zero = F.struct(F.lit(0).alias("matched"), F.lit(0).alias("now"), F.lit(0).alias("best"))
        return F.struct(hit["item_id"].alias("item_id"), start.alias("start"), n.alias("item_words"), F.aggregate(equal, zero, grown).alias("m"))

    found = again.select("doc_id", F.explode(F.transform("hits", compared)).alias("f"))
    found = found.select("doc_id", "f.item_id", "f.start", "f.item_words", F.col("f.m.matched").alias("matched"), F.col("f.m.best").alias("stretch"))
    found = found.where((100 * F.col("matched") >= percent * F.col("item_words")) | (F.col("stretch") >= passage))
    # most equal words, then the earliest start, in one number: hash aggregation carries no arrays through a sort
    place = F.shiftleft(F.col("matched").cast("long"), 34) + (F.lit(1 << 33) - F.col("start").cast("long"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(place).alias("place"), F.max("item_words").alias("item_words"), F.max("stretch").alias("stretch"))
    matched = F.shiftright("place", 34)
    start = F.lit(1 << 33) - (F.col("place") - F.shiftleft(matched, 34))
    return best.select("doc_id", "item_id", matched.cast("int").alias("matched"), "item_words", "stretch", start.cast("int").alias("start"))
