"""Text operators. Tokens live in arrays inside the row; only counts and top lists are shuffled."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.columns import col
from lumenframe.functions.words import (
    DATA_KEYWORDS, EMOJI, ENTITY_PATTERNS, POLARITY_EN, STOPWORDS_EN, WORD, WORD_CHARS,
)
from lumenframe.operators.charts import histogram
from lumenframe.operators.factors import nmf
from lumenframe.operators.summaries import summarize  # noqa: F401  part of this module's interface
from lumenframe.plans.joins import lookup, match
from lumenframe.plans.ordering import with_position
from lumenframe.plans.spread import pieces, spread
from lumenframe.plans.storage import materialize

SPACE = r"\s\p{Z}"
SENTENCE = r"[^.!?]+[.!?]*"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def strip_html(c: Column) -> Column:
    """Text content: no scripts, styles, comments or tags; the common entities decoded."""
    for pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        c = F.regexp_replace(c, pattern, "")
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _without(tokens: Column, stopwords: Sequence[str] | None) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stopwords))) if stopwords else tokens


def _only(tokens, kept: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: w.isin(list(kept)))


def preprocess_text(
    df: DataFrame, column: str, lowercase=True, remove_punct=True, remove_stopwords=True, remove_html=True,
    remove_emojis=True, stopwords: Sequence[str] | None = None, out: str | None = None,
) -> DataFrame:
    """Tokens with a letter, cleaned as asked and joined by spaces; null text gives ''."""
    c = F.coalesce(col(column), F.lit(""))
    if remove_html:
        c = strip_html(c)
    if remove_emojis:
        c = F.regexp_replace(c, EMOJI, "")
    if lowercase:
        c = F.lower(c)
    if remove_punct:
        c = F.regexp_replace(c, rf"[^{WORD_CHARS}{SPACE}-]", "")
    tokens = F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w.rlike(r"\p{L}"))
    if remove_stopwords:
        tokens = _without(tokens, stopwords or STOPWORDS_EN)
    return df.withColumn(out or column, F.array_join(tokens, " "))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """Corpus statistics in one row. A word is a run of non-space characters; a sentence ends with a run
    of '.', '!' or '?' or with the text, and holds at least one word."""
    text = spread(df.select(F.coalesce(col(column), F.lit("")).alias("t")))
    run = rf"[^{SPACE}]+"
    counted = (
        text.select(F.explode(F.regexp_extract_all("t", F.lit(run), 0)).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    )
    by_word = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("word_count"),
        F.count(F.lit(1)).alias("unique_word_count"),
        F.coalesce(F.sum(F.col("n") * F.length("w")), F.lit(0)).alias("_letters"),
    )
    lengths = F.filter(
        F.transform(F.regexp_extract_all("t", F.lit(SENTENCE), 0), lambda s: F.regexp_count(s, F.lit(run))), lambda n: n > 0
    )
    by_text = text.select(lengths.alias("k")).agg(
        F.coalesce(F.sum(F.size("k")), F.lit(0)).alias("sentence_count"),
        F.coalesce(F.sum(F.aggregate("k", F.lit(0), lambda a, b: a + b)), F.lit(0)).alias("_in_sentences"),
    )
    both = by_word.unionByName(by_text, allowMissingColumns=True)
    s = both.agg(*[F.first(c, True).alias(c) for c in both.columns])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return s.select(
        "word_count",
        "sentence_count",
        "unique_word_count",
        share("unique_word_count", "word_count").alias("unique_word_ratio"),
        share("_letters", "word_count").alias("avg_word_length"),
        share("_in_sentences", "sentence_count").alias("avg_sentence_length"),
        (F.col("word_count") / 200).alias("reading_time_minutes"),
    )


def text_counts(df: DataFrame, column: str) -> DataFrame:
    """Characters, words, lines and pages (form feeds + 1) of each text."""
    c = col(column)
    return df.select(
        "*",
        F.length(c).cast("long").alias("characters"),
        F.regexp_count(c, F.lit(rf"[^{SPACE}]+")).cast("long").alias("words"),
        (F.regexp_count(c, F.lit("\n")) + 1).cast("long").alias("lines"),
        (F.regexp_count(c, F.lit("\f")) + 1).cast("long").alias("pages"),
    )


def word_frequency(df: DataFrame, column: str, k: int = 20, by: str | None = None) -> DataFrame:
    """The k most frequent words (per value of ``by``); ties in order of the word."""
    groups = [by] if by else []
    counts = (
        spread(df.select(*[col(g) for g in groups], col(column))).select(*[col(g) for g in groups], F.explode(words(col(column))).alias("word"))
        .groupBy(*groups, "word").agg(F.count(F.lit(1)).alias("n"))
    )
    if not by:
        return counts.orderBy(F.desc("n"), "word").limit(k)
    best = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).drop("_r")


NGRAM_TOKEN = rf"[{WORD_CHARS}]++(?:-++[{WORD_CHARS}]++)*+"


def top_ngrams(df: DataFrame, column: str, n: int = 2, k: int = 10, stopwords: Sequence[str] | None = None) -> DataFrame:
    """The k most frequent n-grams of words (hyphens inside a word stay) after stop words are removed;
    an n-gram has at least one letter."""
    tokens = _without(words(col(column), NGRAM_TOKEN), STOPWORDS_EN if stopwords is None else stopwords)
    lists = spread(df.select(col(column))).select(tokens.alias("w")).filter(F.size("w") >= n)
    at = [F.slice("w", i + 1, F.size("w") - (n - 1)).alias(f"w{i}") for i in range(n)]
    grams = lists.select(F.inline(F.arrays_zip(*at))).select(F.concat_ws(" ", *[f"w{i}" for i in range(n)]).alias("ngram"))
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    # asked of distinct n-grams: a condition on the n-gram alone would be moved below the counts
    return counts.filter(F.when(F.col("n") > 0, F.col("ngram").rlike(r"\p{L}"))).orderBy(F.desc("n"), "ngram").limit(k)


def clean_social(df: DataFrame, column: str, out: str = "cleaned_text") -> DataFrame:
    """Lower case without links, mentions, hash signs and punctuation."""
    c = F.regexp_replace(col(column), rf"(?:http|www)[^{SPACE}]+", "")
    c = F.regexp_replace(c, rf"@[{WORD_CHARS}]+|#", "")
    c = F.regexp_replace(c, rf"[^{WORD_CHARS}{SPACE}]", " ")
    return df.withColumn(out, F.lower(F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " "))))


# ---- sentiment -----------------------------------------------------------------------------

def sentiment(df: DataFrame, column: str, lexicon: Mapping[str, float] | None = None) -> DataFrame:
    """Adds ``sentiment``, ``sentiment_score`` in [-1, 1] and ``confidence``.

    The score is the sum of word weights over the sum of their absolute values. Words of one weight are
    looked up together as a hash set inside the row, so nothing is exploded or shuffled. Text without a
    known word, or in balance, is neutral with confidence 0.5.
    """
    by_weight: dict[float, list[str]] = {}
    for word, weight in (lexicon or POLARITY_EN).items():
        by_weight.setdefault(float(weight), []).append(word)
    hits = spread(df).withColumn("_w", words(col(column)))
    counts = {w: F.size(_only("_w", ws)) for w, ws in by_weight.items()}
    total = sum((F.lit(w) * n for w, n in counts.items()), F.lit(0.0))
    size = sum((F.lit(abs(w)) * n for w, n in counts.items()), F.lit(0.0))
    score = F.coalesce(F.try_divide(total, size), F.lit(0.0))
    scored = hits.withColumn("sentiment_score", score).drop("_w")
    s = F.col("sentiment_score")
    return scored.select(
        *df.columns,
        F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral").alias("sentiment"),
        "sentiment_score",
        F.when(s == 0, 0.5).otherwise(F.abs(s)).alias("confidence"),
    )


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """Counts, shares, mean score, majority class and its wording, in one row."""
    is_ = lambda k: F.count_if(F.col("sentiment") == k)
    s = scored.agg(
        is_("positive").alias("positive"), is_("neutral").alias("neutral"), is_("negative").alias("negative"),
        F.count(F.lit(1)).alias("total"), F.avg("sentiment_score").alias("average"),
    )
    top = F.greatest("positive", "neutral", "negative")
    majority = F.when(F.col("negative") == top, "negative").when(F.col("neutral") == top, "neutral").otherwise("positive")
    share = F.try_divide(top, F.col("total"))
    return s.select(
        "positive", "neutral", "negative", "total", "average",
        *[F.try_divide(F.col(k), F.col("total")).alias(f"{k}_share") for k in ("positive", "neutral", "negative")],
        majority.alias("majority"),
        F.when(share > 0.7, "High Confidence").when(share > 0.5, "Moderate Confidence")
        .otherwise("Low Confidence - mixed sentiments").alias("confidence"),
        F.when(F.abs("average") > 0.5, "strongly").when(F.abs("average") > 0.2, "").otherwise("slightly").alias("strength"),
    )


def sentiment_extremes(scored: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k highest and the k lowest scores."""
    ends = []
    for name, order in (("most positive", F.desc("sentiment_score")), ("most negative", F.asc("sentiment_score"))):
        ends.append(scored.orderBy(order, col(key)).limit(k).select(F.lit(name).alias("end"), col(key), "sentiment_score"))
    return ends[0].unionByName(ends[1])


def sentiment_words(scored: DataFrame, column: str, k: int = 10) -> DataFrame:
    return word_frequency(scored, column, k, by="sentiment")


def sentiment_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(scored, "sentiment_score", bins)


# ---- entities ------------------------------------------------------------------------------

def entities(df: DataFrame, key: str, column: str, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """(key, type, entity) for every match of every pattern; one scan."""

    def matches(name: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(col(column), F.lit(pattern), 0)
        return F.transform(hits, lambda e: F.struct(F.lit(name).alias("type"), e.alias("entity")))

    found = [matches(name, p) for name, p in (patterns or ENTITY_PATTERNS).items()]
    return spread(df.select(col(key), col(column))).select(col(key), F.inline(F.concat(*found)))


def entity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# ---- weights, topics, clusters ---------------------------------------------------------------

TERM = rf"[{WORD_CHARS}]{{2,}}"


def _terms(df: DataFrame, key: str, column: str, stopwords: Sequence[str] | None) -> DataFrame:
    return spread(df.select(col(key), col(column))).select(col(key), _without(words(col(column), TERM), STOPWORDS_EN if stopwords is None else stopwords).alias("terms"))


TERMS = 1_000_000  # terms that may be broadcast


def _term_counts(df: DataFrame, key: str, column: str, stopwords: Sequence[str] | None) -> DataFrame:
    """(key, term, tf), the rows of a key in one partition; texts are dealt by key before they are cut into terms."""
    rows = df.select(col(key), col(column))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces(rows))
    terms = _without(words(col(column), TERM), STOPWORDS_EN if stopwords is None else stopwords)
    return rows.repartition(parts, col(key)).select(col(key), F.explode(terms).alias("term")).groupBy(col(key), "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(
    df: DataFrame, key: str, column: str, max_df: float = 0.95, min_df: int = 2, stopwords: Sequence[str] | None = None
) -> DataFrame:
    """(key, term, tf, weight): tf x (ln((1+n)/(1+df)) + 1), each text scaled to length one.

    Texts, not their terms, are shuffled: once for the document frequencies and once for the weights, and the terms of a
    key are counted and scaled where they lie. The vocabulary is broadcast up to ``TERMS`` terms; beyond that a term found
    in a large share of the texts is a skewed join key, which AQE splits.
    """
    n = df.count()
    tf = _term_counts(df, key, column, stopwords)
    df_counts = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = df_counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    idf = materialize(kept.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("_idf")))
    weighed = match(tf, F.broadcast(idf) if idf.count() <= TERMS else idf, ["term"]).withColumn("_w", F.col("tf") * F.col("_idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(col(key))))  # one text's terms
    return weighed.select(col(key), "term", "tf", (F.col("_w") / length).alias("weight"))


def _vocabulary(terms: DataFrame, min_df: int = 2, max_df: float = 0.95) -> CountVectorizerModel:
    """Counts of every term found in ``min_df`` texts and in a share of ``max_df`` at most; the most frequent term first, then by its letters.

    The vocabulary is part of a topic model and lies on the driver, as its topics do. It is counted by one aggregate and handed
    to the model inside the JVM; Spark's own fit keeps every token of the corpus as an object.
    """
    spark, one, none = terms.sparkSession, F.lit(1), F.lit(0)
    found = terms.select(F.explode(F.array_distinct("terms")).alias("term"), one.alias("df"), none.alias("n"))
    found = found.unionAll(terms.select(F.explode("terms").alias("term"), none.alias("df"), one.alias("n")))
    counts = found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    kept = counts.where((F.col("df") >= min_df) & (F.col("df") <= max_df * terms.count())).orderBy(F.desc("n"), "term").select("term")
    listed = getattr(kept._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING()).collect()
    if not len(listed):
        raise ValueError("no term is found in enough texts, and not in too many")
    return CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", listed).setInputCol("terms").setOutputCol("counts")


def topics(
    df: DataFrame, key: str, column: str, k: int = 5, method: str = "lda", words_per_topic: int = 10,
    iterations: int = 20, seed: int = 42, stopwords: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(topic words, text topics).

    Topic words: (topic, rank, term, weight). Text topics: (key, topic, share), one row per topic.
    ``lda`` fits Spark's LDA on term counts. ``nmf`` factorises the tf-idf weights with the least squared error (``factors.nmf``);
    a text without a term of the vocabulary has no row there.
    """
    if method == "lda":
        terms = _terms(df, key, column, stopwords).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).persist()
        vocabulary = _vocabulary(terms)
        counted = vocabulary.transform(terms).select(col(key), "counts").persist()  # read in every iteration
        # a task sums a number for every term and topic, so there are no more tasks than run at once
        few = counted.coalesce(df.sparkSession.sparkContext.defaultParallelism)
        lda = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="counts", topicDistributionCol="shares").fit(few)
        terms.unpersist()
        names = vocabulary._java_obj.vocabulary()  # stays in the JVM; the few names of the lists are fetched
        listed = lda.describeTopics(words_per_topic).collect()
        rows = [(r.topic, i, names[at], w) for r in listed for i, (at, w) in enumerate(zip(r.termIndices, r.termWeights, strict=True), 1)]
        words_ = df.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")
        shares = lda.transform(counted).select(col(key), F.posexplode(vector_to_array("shares")).alias("topic", "share"))
        return words_, shares
    if method != "nmf":
        raise ValueError(f"unknown topic method {method!r}")
    weights = materialize(tfidf(df, key, column, stopwords=stopwords))
    texts, terms, _ = nmf(weights, key, "term", "weight", k, iterations, seed=seed)
    factors = F.array(*[F.col(f"f{j}") for j in range(k)])
    best = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    words_ = terms.select("term", F.posexplode(factors).alias("topic", "weight")).withColumn("rank", F.row_number().over(best))
    return words_.filter(F.col("rank") <= words_per_topic).select("topic", "rank", "term", "weight"), texts.select(col(key), F.posexplode(factors).alias("topic", "share"))


def dominant_topic(text_topics: DataFrame, key: str) -> DataFrame:
    """(key, topic) with the largest share."""
    return text_topics.groupBy(col(key)).agg(F.max_by("topic", F.struct("share", -F.col("topic"))).alias("topic"))


def cluster_text(
    df: DataFrame, key: str, column: str, k: int = 5, width: int = 1 << 18, seed: int = 42, stopwords: Sequence[str] | None = ()
) -> DataFrame:
    """(key, cluster, features) by k-means on tf-idf vectors of length one, the weights of ``tfidf``.

    All terms count; each goes to one of ``width`` places by its hash, so no vocabulary is collected.
    """
    counted = HashingTF(numFeatures=width, inputCol="terms", outputCol="counts").transform(_terms(df, key, column, stopwords))
    idf = IDF(inputCol="counts", outputCol="_idf").fit(counted)
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="counts", outputCol="_weights").transform(counted)
    unit = Normalizer(inputCol="_weights", outputCol="features").transform(weighed).select(col(key), "features")
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(unit).transform(unit).select(col(key), "cluster", "features")


def cluster_vectors(df: DataFrame, key: str, column: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, cluster, features) by k-means on an array column."""
    x = df.select(col(key), array_to_vector(col(column).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(x).transform(x)


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def cluster_map(clustered: DataFrame, key: str) -> DataFrame:
    """(key, cluster, x, y): two principal components of the features."""
    flat = PCA(k=2, inputCol="features", outputCol="_xy").fit(clustered).transform(clustered)
    xy = vector_to_array("_xy")
    return flat.select(col(key), "cluster", xy[0].alias("x"), xy[1].alias("y"))


# ---- search --------------------------------------------------------------------------------

def search_text(df: DataFrame, column: str, query: str, regex: bool = False) -> DataFrame:
    """Rows that contain the query, ignoring case, or that match it as a (case-sensitive) pattern."""
    return df.filter(col(column).rlike(query) if regex else F.contains(F.lower(col(column)), F.lit(query.lower())))


def is_data_related(df: DataFrame, column: str, keywords: Sequence[str] | None = None) -> DataFrame:
    """Adds ``data_related``: the text contains one of the keywords."""
    pattern = "|".join(re.escape(w) for w in (keywords or DATA_KEYWORDS))
    return df.withColumn("data_related", F.coalesce(F.lower(col(column)).rlike(pattern), F.lit(False)))
