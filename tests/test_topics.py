"""The vocabulary of an LDA model and the rows it gives."""

from collections import Counter

from lumenframe.catalog import QUERIES
from lumenframe.operators import text as tx

TEXTS = ["red red blue", "blue green", "green red", "red yellow", None, "", "blue blue green red"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_vocabulary_is_ordered_and_bounded(spark):
    terms = frame(spark).selectExpr("coalesce(split(text, ' '), array()) as terms")
    model = tx._vocabulary(terms, 2, 0.95)
    n, df = Counter(w for t in TEXTS if t for w in t.split()), Counter(w for t in TEXTS if t for w in set(t.split()))
    assert list(model.vocabulary) == sorted((w for w in n if 2 <= df[w] <= 0.95 * len(TEXTS)), key=lambda w: (-n[w], w)) == ["red", "blue", "green"]
    assert list(tx._vocabulary(terms, 2, 0.5).vocabulary) == ["blue", "green"]  # four of seven texts hold red
    row = model.transform(terms.where("size(terms) = 4")).first()
    assert row.counts.toArray().tolist() == [1.0, 2.0, 1.0]


def test_lda_tasks_do_not_grow_with_the_pieces(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(tx, "spread", lambda df: df.repartition(40))
    monkeypatch.setattr(tx.LDA, "fit", lambda self, df, real=tx.LDA.fit: fitted.append(df.rdd.getNumPartitions()) or real(self, df))
    words, shares = tx.topics(frame(spark), "doc_id", "text", 2, "lda", words_per_topic=3, iterations=2)
    assert fitted == [spark.sparkContext.defaultParallelism]
    got = words.collect()
    assert words.dtypes == [("topic", "int"), ("rank", "int"), ("term", "string"), ("weight", "double")]
    assert sorted((r.topic, r["rank"]) for r in got) == [(t, r) for t in range(2) for r in (1, 2, 3)]
    assert all({r.term for r in got if r.topic == t} == {"red", "blue", "green"} for t in range(2)) and shares.count() == 2 * len(TEXTS)


def test_every_text_has_a_dominant_topic(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.topic for r in QUERIES["tx12_dominant_topic"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(TEXTS))) and set(got.values()) <= set(range(4))
