import random

import helpers

from siftline.llm import classifier


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(3)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "tu") for b in ("ra", "no", "sti", "lem")]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) + r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        good = i % 3 > 0
        if not good:
            w = [x + r.choice(["***", "$$$"]) for x in w] if i % 2 else w[:4] * 15
        rows.append((i, " ".join(w), "en", "s", None, 1, 2, None))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, None, 0), (10**6, 0, 0)]
    rows += [(None, None, None, None, None, None, None, None), (7000, "", None, None, None, None, None, None), (7001, "x" * 300000, None, None, None, None, None, None)]
    docs = helpers.frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, known, held_out=classifier.held_out())
    out = classifier.score(docs, model, out="kept").withColumn("held", classifier.held_out()).collect()
    assert len(out) == len(rows) and all(0 <= x["kept"] <= 1 for x in out)
    held = [x for x in out if x["held"] and x["doc_id"] < 600]
    assert len(held) > 80
    assert sum((x["kept"] >= 0.5) == (x["doc_id"] % 3 > 0) for x in held) >= 0.97 * len(held)


def test_without_labels_the_prior(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert 0.5 < classifier.score(docs, classifier.fit(docs, labels)).first()["score"] < 1
    assert classifier.score(docs, classifier.fit(docs, labels.limit(0))).first()["score"] == 0.5
    assert classifier.score(docs.limit(0), classifier.fit(docs.limit(0), labels)).count() == 0
