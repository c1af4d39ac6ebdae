"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog.inputs import rounded
from lumenframe.catalog.registry import query
from lumenframe.functions.words import DATA_KEYWORDS, EMOJI, ENTITY_PATTERNS, POLARITY_EN, STOPWORDS_EN, WORD, WORD_CHARS
from lumenframe.operators import text as tx
from lumenframe.operators.text import NGRAM_TOKEN, SENTENCE, SPACE, TERM

STOP = ", ".join(f"'{w}'" for w in STOPWORDS_EN)
_TOKENS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM documents"

_html = "html"
for _p in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
    _html = f"regexp_replace({_html}, '{_p}', '', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _html = f"replace({_html}, '{_a}', '{_b}')"
_clean = f"regexp_replace(lower(regexp_replace({_html}, '{EMOJI}', '', 'g')), '[^{WORD_CHARS}{SPACE}-]', '', 'g')"
query("tx1_preprocess_text", f"""SELECT page_id, array_to_string(list_filter(regexp_split_to_array({_clean}, '[{SPACE}]+'), lambda w: regexp_matches(w, '\\p{{L}}') AND w NOT IN ({STOP})), ' ') AS html FROM pages""")(
    lambda t: tx.preprocess_text(t.pages.select("page_id", "html"), "html")
)
query("tx2_text_stats", f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^{SPACE}]+')) AS w FROM documents), a AS (SELECT count(*) AS n, count(DISTINCT w) AS u, sum(length(w)) AS l FROM w),
  k AS (SELECT len(regexp_extract_all(s, '[^{SPACE}]+')) AS k FROM (SELECT unnest(regexp_extract_all(text, '{SENTENCE}')) AS s FROM documents)), b AS (SELECT count(*) AS s, sum(k) AS in_s FROM k WHERE k > 0)
  SELECT n AS word_count, s AS sentence_count, u AS unique_word_count, round(u / n, 8) AS unique_word_ratio, round(l / n, 8) AS avg_word_length, round(in_s / s, 8) AS avg_sentence_length, round(n / 200, 4) AS reading_time_minutes FROM a, b""")(
    lambda t: tx.text_stats(t.documents, "text").select(
        "word_count", "sentence_count", "unique_word_count", *[F.round(c, 8).alias(c) for c in ("unique_word_ratio", "avg_word_length", "avg_sentence_length")],
        F.round("reading_time_minutes", 4).alias("reading_time_minutes"))
)
query("tx3_text_counts", f"""SELECT doc_id, length(text) AS characters, CAST(len(regexp_extract_all(text, '[^{SPACE}]+')) AS BIGINT) AS words,
  length(text) - length(replace(text, chr(10), '')) + 1 AS lines, length(text) - length(replace(text, chr(12), '')) + 1 AS pages FROM documents""")(
    lambda t: tx.text_counts(t.documents, "text").select("doc_id", "characters", "words", "lines", "pages")
)
query("tx4_word_frequency", f"SELECT word, count(*) AS n FROM ({_TOKENS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")(
    lambda t: tx.word_frequency(t.documents, "text")
)
query("tx4_word_cloud", f"SELECT word, count(*) AS n FROM ({_TOKENS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 200")(
    lambda t: tx.word_frequency(t.documents, "text", 200)
)
_GRAMS = f"w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{NGRAM_TOKEN}'), lambda x: x NOT IN ({STOP})) AS w FROM documents)"
for _n in (1, 2, 3):
    query(f"tx5_top_ngrams_{_n}", f"""WITH {_GRAMS}, p AS (SELECT w, unnest(range(1, len(w) - {_n - 2})) AS i FROM w WHERE len(w) >= {_n}), g AS (SELECT array_to_string(w[i:i + {_n - 1}], ' ') AS ngram FROM p)
      SELECT ngram, count(*) AS n FROM g WHERE regexp_matches(ngram, '\\p{{L}}') GROUP BY 1 ORDER BY n DESC, ngram LIMIT 10""")(
        lambda t, _n=_n: tx.top_ngrams(t.documents, "text", _n)
    )
query("tx6_clean_social", f"""SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:http|www)[^{SPACE}]+', '', 'g'), '@[{WORD_CHARS}]+|#', '', 'g'), '[^{WORD_CHARS}{SPACE}]', ' ', 'g'), '[{SPACE}]+', ' ', 'g'))) AS cleaned_text FROM documents""")(
    lambda t: tx.clean_social(t.documents.select("doc_id", "text"), "text").drop("text")
)
# Word polarity for this corpus of invented prose: function words of the four languages stand in for opinions.
LEXICON = {**dict.fromkeys(["the", "and", "les", "und", "los", "with"], 1.0), **dict.fromkeys(["of", "that", "une", "der", "que", "was"], -1.0), **dict.fromkeys(["this", "not"], -2.0)}
_W = " + ".join(f"{w} * len(list_filter(t, lambda x: x IN ({', '.join(repr(k) for k, v in LEXICON.items() if v == w)})))" for w in (1.0, -1.0, -2.0))
_A = " + ".join(f"{abs(w)} * len(list_filter(t, lambda x: x IN ({', '.join(repr(k) for k, v in LEXICON.items() if v == w)})))" for w in (1.0, -1.0, -2.0))
SENT = f"""tok AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents),
  sc AS (SELECT doc_id, text, CAST(CASE WHEN ({_A}) > 0 THEN ({_W}) / ({_A}) ELSE 0 END AS DOUBLE) AS s FROM tok),
  sent AS (SELECT doc_id, text, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, s AS sentiment_score, CASE WHEN s = 0 THEN 0.5 ELSE abs(s) END AS confidence FROM sc)"""


def scored(t):
    return tx.sentiment(t.documents.select("doc_id", "text"), "text", LEXICON)


query("tx7_sentiment", f"WITH {SENT} SELECT doc_id, sentiment, round(sentiment_score, 8) AS sentiment_score, round(confidence, 8) AS confidence FROM sent")(
    lambda t: rounded(scored(t).drop("text"), 8)
)
_POS, _NEG = (", ".join(f"'{w}'" for w, v in POLARITY_EN.items() if v == x) for x in (1.0, -1.0))
query("tx7_sentiment_default", f"""WITH t AS (SELECT regexp_extract_all(lower(text), '{WORD}') AS t FROM conversations), s AS (SELECT len(list_filter(t, lambda x: x IN ({_POS}))) - len(list_filter(t, lambda x: x IN ({_NEG}))) AS s FROM t)
  SELECT CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS sentiment, count(*) AS count FROM s GROUP BY 1""")(lambda t: tx.sentiment(t.conversations, "text").groupBy("sentiment").count())
query("tx8_sentiment_summary", f"""WITH {SENT}, a AS (SELECT count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (sentiment = 'negative') AS negative, count(*) AS total, avg(sentiment_score) AS average FROM sent),
  m AS (SELECT sentiment AS majority, count(*) AS c FROM sent GROUP BY 1 ORDER BY c DESC, 1 LIMIT 1)
  SELECT positive, neutral, negative, total, round(average, 6) AS average, round(positive / total, 6) AS positive_share, round(neutral / total, 6) AS neutral_share, round(negative / total, 6) AS negative_share, majority,
  CASE WHEN c / total > 0.7 THEN 'High Confidence' WHEN c / total > 0.5 THEN 'Moderate Confidence' ELSE 'Low Confidence - mixed sentiments' END AS confidence,
  CASE WHEN abs(average) > 0.5 THEN 'strongly' WHEN abs(average) > 0.2 THEN '' ELSE 'slightly' END AS strength FROM a, m""")(
    lambda t: rounded(tx.sentiment_summary(scored(t)), 6)
)
query("tx9_sentiment_extremes", f"""WITH {SENT} (SELECT 'most positive' AS "end", doc_id, round(sentiment_score, 8) AS sentiment_score FROM sent ORDER BY sent.sentiment_score DESC, doc_id LIMIT 3)
  UNION ALL (SELECT 'most negative', doc_id, round(sentiment_score, 8) FROM sent ORDER BY sent.sentiment_score, doc_id LIMIT 3)""")(
    lambda t: rounded(tx.sentiment_extremes(scored(t), "doc_id"), 8)
)
query("tx9_sentiment_words", f"""WITH {SENT}, w AS (SELECT sentiment, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM sent), c AS (SELECT sentiment, word, count(*) AS n FROM w GROUP BY 1, 2)
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, word) <= 10""")(lambda t: tx.sentiment_words(scored(t), "text"))
query("tx9_sentiment_histogram", f"""WITH {SENT}, s AS (SELECT min(sentiment_score) AS lo, max(sentiment_score) AS hi FROM sent)
  SELECT CAST(least(floor((sentiment_score - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM sent, s GROUP BY 1""")(
    lambda t: tx.sentiment_histogram(scored(t)).select("bin", "n")
)
_ENT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS entity FROM documents" for k, p in ENTITY_PATTERNS.items())
query("tx10_entities", _ENT)(lambda t: tx.entities(t.documents, "doc_id", "text"))
query("tx10_entity_counts", f"SELECT type, count(*) AS n FROM ({_ENT}) GROUP BY 1")(lambda t: tx.entity_counts(tx.entities(t.documents, "doc_id", "text")))
query("tx11_tfidf", f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{TERM}'), lambda x: x NOT IN ({STOP}))) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
  n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT doc_id, tf.term, tf, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM tf JOIN d ON tf.term = d.term, n WHERE df >= 2 AND df <= 0.95 * n)
  SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")(lambda t: rounded(tx.tfidf(t.documents, "doc_id", "text"), 6))
query("tx12_topics_lda")(lambda t: tx.topics(t.documents, "doc_id", "text", 4, "lda", iterations=5)[0])
query("tx12_dominant_topic")(lambda t: tx.dominant_topic(tx.topics(t.documents, "doc_id", "text", 4, "lda", iterations=5)[1], "doc_id"))
query("tx13_topics_nmf")(lambda t: tx.topics(t.documents, "doc_id", "text", 4, "nmf")[0])
query("tx14_summarize")(lambda t: tx.summarize(t.documents, "doc_id", "text"))
query("tx15_cluster_text")(lambda t: tx.cluster_sizes(tx.cluster_text(t.documents, "doc_id", "text")))
query("tx15_cluster_map")(lambda t: tx.cluster_map(tx.cluster_text(t.documents, "doc_id", "text", width=1024), "doc_id"))
query("tx16_cluster_vectors")(lambda t: tx.cluster_sizes(tx.cluster_vectors(t.embeddings, "vec_id", "embedding")))
query("tx17_search_text", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'tion the')")(
    lambda t: tx.search_text(t.documents, "text", "Tion THE").select("doc_id", "lang")
)
query("tx17_search_regex", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[A-Z][a-z]+ing\\.')")(
    lambda t: tx.search_text(t.documents, "text", r"[A-Z][a-z]+ing\.", regex=True).select("doc_id", "lang")
)
query("tx18_is_data_related", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{w}')" for w in DATA_KEYWORDS) + " AS data_related FROM conversations")(
    lambda t: tx.is_data_related(t.conversations, "text").select("conv_id", "turn", "data_related")
)
