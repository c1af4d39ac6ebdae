"""Near-equal categories against a sequential scan, and the candidate filter against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions.similarity import ratio_above, token_sort_key
from lumenframe.operators import categories


def scan(values, threshold=85):
    leaders = {}
    for v in values:
        hit = next((k for k in leaders if ratio_above(token_sort_key(v), token_sort_key(k), threshold)), None)
        leaders.setdefault(hit if hit is not None else v, []).append(v)
    return {v: k for k, vs in leaders.items() for v in vs}


def merged(spark, values, threshold=85, **options):
    """Leaders of values that come in this order, by falling frequency."""
    rows = spark.createDataFrame([(v, len(values) - i) for i, v in enumerate(values)], "c string, n int").repartition(4)
    df = rows.select("c", F.explode(F.sequence(F.lit(1), F.col("n")))).select("c")
    return {r.value: r.leader for r in categories.category_leaders(df, "c", threshold, **options).collect()}


def variants(n, seed, alphabet="abcdefgh", length=(1, 24)):
    """Names with small changes to each other, so that chains of similar names occur."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = list(rng.choice(out)) if out and rng.random() < 0.7 else [rng.choice(alphabet + " ") for _ in range(rng.randint(*length))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(base))
            if rng.random() < 0.5 and base:
                del base[min(at, len(base) - 1)]
            else:
                base.insert(at, rng.choice(alphabet + "  !"))
        name = "".join(base).strip()
        if name and name not in out:
            out.append(name)
    return out


def test_sort_key_equals_the_plain_one(spark):
    names = ["New York", " b  a!c ", "Été_9 x", "", "---", "\tTab\nLine", "ÀB cd", "z Z y"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert [r[0] for r in df.select(categories.sort_key(F.col("v"))).collect()] == [token_sort_key(n) for n in names]


def test_known_names(spark):
    names = ["New York", "new york", "New  York!", "York New", "Boston", "Bostn", "Bosston", "Chicago", "Chicag", "LA", "Boston MA", "Bostonn", "!!", "??", "é"]
    assert merged(spark, names) == scan(names)


@pytest.mark.parametrize(("threshold", "length", "seed"), [(85, (1, 24), 1), (85, (30, 60), 2), (70, (1, 16), 3), (95, (5, 40), 4), (55, (1, 10), 5)])
def test_equal_to_the_sequential_scan(spark, threshold, length, seed):
    names = variants(150, seed, length=length)
    assert merged(spark, names, threshold) == scan(names, threshold)


def test_many_steps_give_the_same_leaders(spark, monkeypatch):
    monkeypatch.setattr(categories, "LEAST", 1)
    names = variants(60, 8)
    assert merged(spark, names, pairs=2) == scan(names)


@pytest.mark.parametrize("threshold", [60, 85, 90])
def test_no_similar_pair_escapes_the_segments(spark, threshold):
    names = variants(400, threshold, length=(1, 60))
    keys = sorted({token_sort_key(n) for n in names} - {""})
    df = spark.createDataFrame(list(enumerate(keys)), "rank long, key string")
    found = categories.segments(df, threshold)
    pairs = found.where("not long").alias("s").join(found.where("long").alias("l"), "sig").select("s.rank", F.col("l.rank").alias("other")).distinct()
    got = {frozenset(r) for r in pairs.collect()}
    want = {frozenset((i, j)) for i, a in enumerate(keys) for j, b in enumerate(keys[:i]) if ratio_above(a, b, threshold) or ratio_above(b, a, threshold)}
    assert want and want <= got and len(got) < len(keys) ** 2 / 2


def test_first_independent_set_follows_the_order(spark):
    rng = random.Random(3)
    edges = {(max(a, b), min(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(500)) if a != b}
    names = spark.range(300).select(F.col("id").alias("rank"))
    got = {r.rank for r in categories.first_independent_set(names, spark.createDataFrame(list(edges), "later long, earlier long")).collect()}
    want = set()
    for i in range(300):
        if not any((i, j) in edges for j in want):
            want.add(i)
    assert got == want


def test_one_dense_group_is_decided_by_its_leader(spark, monkeypatch):
    """Thousands of names that all resemble each other make few pairs: the first leader takes them."""
    monkeypatch.setattr(categories, "LEAST", 1)
    made = []
    monkeypatch.setattr(categories, "_alike", lambda pairs, names, threshold, real=categories._alike: made.append(pairs.distinct().count()) or real(pairs, names, threshold))
    df = spark.range(3000).select(F.format_string("customer number %05d", "id").alias("c"))
    leaders = categories.category_leaders(df, "c", pairs=5)
    assert leaders.select("leader").distinct().count() < 40 and sum(made) < 3000 * 60


def test_empty_and_null_only(spark):
    assert merged(spark, []) == {}
    assert categories.category_leaders(spark.createDataFrame([(None,)], "c string"), "c").collect() == []
