import zlib

import numpy as np

from tarnbridge.llm import quality as Q

from .conftest import ODD


def test_held_out_accuracy(spark, data):
    """On rows that no label was learned from, and scores that depend on the text alone."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 10 and np.mean([a == b for a, b in judged]) >= 0.9


def test_learns_nothing_from_held_out_rows(spark, data):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels), Q.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_features_are_distinct():
    ids = Q.features("abcabc " * 50)
    assert len(ids) == len(set(ids.tolist()))
    shapes = lambda t: sorted(i - 2 * Q.DIMENSIONS for i in Q.features(t).tolist() if i >= 2 * Q.DIMENSIONS)
    assert shapes("a") == [] and shapes("a b") == [0] and shapes("a a") == [1] and shapes("a b c") == [0, 2] and shapes("a a a") == [1, 5] and shapes("a a b") == [0, 1, 4] and shapes("a b b") == [0, 1, 3]
    assert shapes("a " * 9) == [1, 5, 13, 29] and max(shapes("a b a b c c c c c c a")) == Q.FEATURES - 2 * Q.DIMENSIONS - 1
    words = lambda t: {i for i in Q.features(t).tolist() if Q.DIMENSIONS <= i < 2 * Q.DIMENSIONS}
    assert len(words("one two three")) == 5 and words("one two") < words("one two three") and words("one two") == words(" one\n two ")
    assert len(Q.features("")) == len(Q.features(None)) == 0 and len(Q.features("x")) == 2


def _plain_fit(texts, labels):
    """Ratios by counting, and the dual of the hinge loss by small projected steps."""
    size = max(max(t) for t in texts) + 1
    counts = {k: [Q.SMOOTHING + sum(f in t for t, y in zip(texts, labels, strict=True) if y == k) for f in range(size)] for k in (0, 1)}
    rest = (Q.FEATURES - size) * Q.SMOOTHING
    ratio = np.array([np.log(counts[1][f] / (sum(counts[1]) + rest)) - np.log(counts[0][f] / (sum(counts[0]) + rest)) for f in range(size)])
    x = np.array([[ratio[f] * (f in t) for f in range(size)] for t in texts])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.hstack([x, np.ones((len(x), 1))])  # the bias is a feature of its own
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    gram = (x @ x.T) * np.outer(y, y)
    dual = np.zeros(len(x))
    for _ in range(30_000):
        dual = np.clip(dual - (gram @ dual - 1) / np.linalg.norm(gram, 2), 0, Q.COST)
    return ratio, (dual * y) @ x


def test_fit_and_scores_against_plain_computation(monkeypatch):
    monkeypatch.setattr(Q, "EPOCHS", 1000)
    r = np.random.default_rng(4)
    labels = [1] * 9 + [0] * 8
    texts = [sorted({int(f) for f in r.integers(0, 30, 9)} | {30 + int(r.random() < 0.8) if y else 31 + int(r.random() < 0.8)}) for y in labels]
    ratio, w = _plain_fit(texts, labels)
    model, bias = Q.fit([np.array(t, np.int32) for t in texts], np.array(labels))
    seen = np.zeros(len(ratio), bool)
    seen[sorted(set().union(*texts))] = True
    firm = seen
    mixed = Q.FITTED * w[:-1] + (1 - Q.FITTED) * np.abs(w[:-1][seen]).mean()  # as published: of the mean and the fitted weight
    assert np.allclose(model[1, : len(ratio)][seen], ratio[seen], atol=1e-5)
    assert abs(bias - w[-1]) < 1e-3 and np.allclose(model[0, : len(ratio)][firm], (mixed * ratio)[firm], atol=1e-3)
    assert firm.sum() > 25
    for t in texts:
        if not all(firm[t]):
            continue
        plain = sum(mixed[f] * ratio[f] for f in t) / np.sqrt(sum(ratio[f] ** 2 for f in t)) + w[-1]
        assert abs(Q.margin((model, bias), np.array(t, np.int32)) - plain) < 5e-3


def test_one_text_of_a_shared_doc_id_is_learned_from(docs, spark):
    rows = [(1, f"good text number {i}") for i in range(50)] + [(2, "bad bad bad")]
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id bigint, quality int, text string")
    found = []
    Q_fit, Q.fit = Q.fit, lambda texts, y: found.append((len(texts), sorted(y.tolist()))) or Q_fit(texts, y)
    try:
        assert Q.classify(docs(rows), labels).count() == 51
    finally:
        Q.fit = Q_fit
    assert found in ([(2, [0, 1])], [(1, [1])], [(1, [0])], [(0, [])])  # of the ids that aren't held out


def test_odd_rows(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    assert Q.classify(docs(ODD), labels).count() == len(ODD)
    for none in (labels.limit(0), labels.filter("quality = 1")):
        assert {r["predicted"] for r in Q.classify(docs(ODD), none).collect()} == {1}
    assert Q.classify(docs([]), labels).count() == 0


def test_fit_is_of_the_hinge_loss():
    """Three texts against one with the same feature: the margin is 1, where the squared hinge has 0.47."""
    model, bias = Q.fit([np.array([5], np.int32)] * 4, np.array([1, 1, 1, 0]))
    assert abs(bias - 0.5) < 1e-6 and np.isfinite(model).all()


def test_long_text_and_kept_columns(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), "x") for i in range(40)], "doc_id bigint, quality int, score string")
    d = docs([(i, "plain words of a text here " * 3 if i % 2 == 0 else "junk junk junk " * 3) for i in range(40)] + [(99, "plain words of a text here " * 100_000), (100, None)])
    kept = Q.keep_good(d, labels)
    assert kept.columns == d.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids - {100} == {*range(0, 40, 2), 99}
