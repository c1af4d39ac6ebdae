"""Personal data and the terms that reveal it: information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by patterns over whole texts. Each
distinct value is a protected entity. A term (a word of four letters or more) that stands in a text with an entity, anywhere
outside base spans, may reveal it even when the entity itself is masked. How much is estimated over the corpus: with N texts,
n(e) that hold the entity, n(t) that hold the term and n(t,e) that hold both,

    disclosure(t, e) = log2(N n(t,e) / (n(t) n(e))) / log2(N / n(e)),

the share of the entity's information that the term gives away. Terms of at least ``threshold`` are spans too (those of
n(t,e) under ``support`` are not looked at; 1 leaves none out, for most personal values stand in one text), wherever they
stand in a text with that entity; ``sanitised`` replaces base spans by their kind and generalises such terms to a class.

Entities in the same texts are one class, and so are terms of equal n(t) in the same texts with entities, so the values and
words of one text, or of its copies, meet as a few classes. As n(t,e) is at most n(e), a term can reach the threshold only if
n(t) <= N^(1 - threshold) n(e)^threshold: other pairs of classes are not formed.

Only DataFrame functions are used. Positions come from splitting a text at the pattern: pieces and matches alternate, so
starts are sums of their lengths in code points. One pass over the texts finds the candidates and writes them down, with
the text if one is valid (few are); another counts, for the terms of those texts, the texts that hold them.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenframe.plans.storage import materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract in forms that Java's matcher runs in linear time and without recursion. A run of
#: local-part characters or digits is entered at its start or where the last match ended, which finds the same matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{L}{4,}"
TERMS = 1_000_000  # terms that may be broadcast


def _candidates(kind: str) -> Column:
    """Matches with the code points since the last match, as an array of structs."""
    pieces, found = F.col(f"{kind}_pieces"), F.col(f"{kind}_found")
    both = F.arrays_zip(found.alias("found"), F.slice(pieces, 1, F.size(found)).alias("before"))
    return F.transform(both, lambda x: F.struct(x["found"].alias("found"), F.length(x["before"]).alias("gap")))


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 2) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255"))
    return (
        F.when(kind == 1, F.forall(F.split(found, r"\."), part))
        .when(kind == 2, n.between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == 3, n.between(8, 15))
        .otherwise(True)
    )


def _scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, the candidates of each kind and the text if one of them is valid, written down."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    columns = []
    for kind in KINDS:
        has = F.contains("text", F.lit("@")) if kind == "email" else F.contains("text", F.lit("+")) if kind == "phone" else F.rlike("text", F.lit("[0-9]"))
        columns.append(F.when(has, F.split("text", PATTERNS[kind], -1)).alias(f"{kind}_pieces"))
        columns.append(F.when(has, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{kind}_found"))
    found = texts.select("doc_id", "text", *columns)
    held = reduce(Column.__or__, [F.exists(f"{k}_found", partial(_valid, F.lit(i))) for i, k in enumerate(KINDS)])
    kept = [F.when(F.size(f"{k}_found") > 0, _candidates(k)).alias(k) for k in KINDS]
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *kept, F.when(held, F.col("text")).alias("text")))


def _base(scanned: DataFrame) -> DataFrame:
    """row, kind (number), found, start, end of the valid matches."""
    rows = [scanned.where(F.col(k).isNotNull()).select("row", F.lit(i).alias("kind"), F.posexplode(k).alias("pos", "m")) for i, k in enumerate(KINDS)]
    rows = reduce(DataFrame.union, rows).select("row", "kind", "pos", "m.*")
    upto = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("found"))
    return rows.where(_valid(F.col("kind"), F.col("found"))).select("row", "kind", "found", "start", "end")


def _words(scanned: DataFrame, base: DataFrame) -> DataFrame:
    """row, term, start, end of every word of a text with base spans that overlaps none of them."""
    cut = scanned.where("text is not null").select("row", F.split("text", WORD, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0)).alias("words"))
    cut = cut.select("row", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("words")).alias("gap"), F.col("words").alias("word"))).alias("pos", "m"))
    upto = W.partitionBy("row").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("end", F.sum(F.length("m.gap") + F.length("m.word")).over(upto))
    placed = cut.select("row", F.lower("m.word").alias("term"), (F.col("end") - F.length("m.word")).alias("start"), "end")
    marks = placed.union(base.select("row", F.lit(None).cast("string"), "start", "end"))
    # the base spans that start before a word, and those that start no earlier
    order = W.partitionBy("row").rowsBetween(W.unboundedPreceding, -1)
    base_only = lambda c: F.when(F.col("term").isNull(), F.col(c))
    last = F.coalesce(F.max(base_only("end")).over(order.orderBy("start", "end", "term")), F.lit(0))
    following = F.min(base_only("start")).over(order.orderBy(F.desc("start"), F.desc("end"), F.desc("term")))
    marks = marks.withColumn("last", last).withColumn("following", following)
    return marks.where("term is not null and last <= start and (following is null or following >= end)").select("row", "term", "start", "end")


def _same_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, n, a, b: number and fingerprint (128 bits) of the texts that hold it; ``rows`` has distinct (row, key)."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))


def _revealing(docs: DataFrame, base: DataFrame, words: DataFrame, threshold: float, support: int) -> DataFrame:
    """row, term of the terms whose disclosure of an entity of that text is at or above the threshold."""
    total = docs.count()
    entity = F.concat_ws(":", F.col("kind").cast("string"), F.when(F.col("kind") >= 2, F.regexp_replace("found", "[^0-9]", "")).otherwise(F.lower("found")))
    entities = base.select("row", entity.alias("entity")).distinct()
    held = entities.join(_same_rows(entities, "entity"), "entity").select("row", F.col("n").alias("n_e"), F.struct("n", "a", "b").alias("who")).distinct()
    seen = materialize(words.select("row", "term").distinct())
    terms = materialize(_same_rows(seen, "term"))
    wanted = F.broadcast(terms.select("term")) if terms.count() <= TERMS else terms.select("term")
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(0)))).alias("term"))
    counts = every.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    most = held.agg(F.max("n_e")).first()[0] or 1
    # the share of all texts that a term may stand in, with some room for rounding
    rare = lambda n_e: F.col("n_t") <= F.lit((1 + 1e-9) * total ** (1 - threshold)) * F.pow(n_e, F.lit(float(threshold)))
    bounded = terms.join(counts.where(rare(F.lit(float(most)))), "term").select("term", "n_t", F.struct("n", "n_t", "a", "b").alias("what"))
    bounded = materialize(seen.join(bounded, "term"))
    pairs = materialize(held.join(bounded.select("row", "n_t", "what").distinct(), "row").where(rare(F.col("n_e"))).select("row", "who", "what", "n_e", "n_t"))
    known = pairs.groupBy("who", "what").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).where(F.col("n_te") >= support)
    # the words of a text may be cut otherwise in lower case, so a term counts at least where it was seen
    gained = F.log2(F.lit(float(total)) * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    whole = F.log2(F.lit(float(total)) / F.col("n_e"))
    known = known.where((whole > 0) & (gained >= threshold * whole)).select("who", "what")
    return bounded.join(pairs.join(known, ["who", "what"]).select("row", "what").distinct(), ["row", "what"]).select("row", "term")


def spans(docs: DataFrame, threshold: float = 0.8, support: int = 1) -> DataFrame:
    """doc_id, base (array of kind, start, end), terms (the same, kind 4) of every row; sorted, code points, end exclusive."""
    scanned = _scan(docs)
    base = materialize(_base(scanned))
    words = materialize(_words(scanned, base))
    marked = words.join(_revealing(docs, base, words, threshold, support), ["row", "term"]).select("row", "start", "end")
    span = lambda kind: F.struct(F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), "start", "end")
    per_row = base.groupBy("row").agg(F.array_sort(F.collect_list(span(F.col("kind")))).alias("base"))
    per_term = marked.groupBy("row").agg(F.array_sort(F.collect_list(span(len(KINDS)))).alias("terms"))
    both = scanned.select("row", "doc_id").join(per_row, "row", "left").join(per_term, "row", "left")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return both.select("doc_id", "row", F.coalesce("base", none).alias("base"), F.coalesce("terms", none).alias("terms"))


def _text(items: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii(docs: DataFrame, threshold: float = 0.8, support: int = 1) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs`` (doc_id, text; others are not read).

    A null text is empty and has no spans (the digest is that of the empty string). Rows that repeat an id, or have none,
    are separate rows and separate texts in the counts. An empty table gives no rows.
    """
    found = spans(docs, threshold, support)
    of_kind = lambda i: F.filter("base", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "terms")).alias("spans"))


def sanitised(docs: DataFrame, threshold: float = 0.8, support: int = 1) -> DataFrame:
    """doc_id and the text with base spans replaced by ``[KIND]`` and revealing terms by ``[TERM]``; ids must be distinct."""
    found = spans(docs, threshold, support).select("doc_id", F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("s"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    text = F.coalesce("text", F.lit(""))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, grown).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    return docs.select("doc_id", "text").join(found, "doc_id").select("doc_id", F.when(F.size("s") > 0, masked).otherwise(text).alias("text"))
