from collections import Counter, defaultdict
from hashlib import sha256

import helpers

from siftline import session
from siftline.llm import exact


def test_marks_and_drops(spark):
    rows = helpers.corpus()
    docs = helpers.frame(spark, rows)
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for i in ids:
            want[i, keep, len(ids), i == keep, sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.mark_copies(docs).collect())) == want
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert len(kept) == len(groups)
    assert {(t or ""): i for i, t in kept} == {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}


def test_large_groups_do_not_need_a_broadcast(spark, monkeypatch):
    rows = helpers.corpus(2)
    docs = helpers.frame(spark, rows)
    want = sorted(map(repr, exact.mark_copies(docs).collect()))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, exact.mark_copies(docs).collect())) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], helpers.SCHEMA)
    assert exact.mark_copies(docs).count() == 0 == exact.drop_copies(docs).count()


def test_no_python_on_the_main_path(spark):
    plan = exact.mark_copies(helpers.frame(spark, helpers.corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
