"""Phrases of any number of words, by the substring test."""

from provisio.operators import retrieval


def test_short_phrases(spark):
    phrases = [(n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 10)] + [(20, "absent"), (21, ""), (22, None)]
    texts = [" ".join(f"w{k}" for k in range(n)) for n in range(12)] + ["xw0 w1y", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = retrieval.phrase_matches(docs, spark.createDataFrame(phrases, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, t in enumerate(texts) for k, p in phrases if t and p and p in t)
