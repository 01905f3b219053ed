import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattquill.llm import toxicity as tx


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(3)
    x = rng.random((700, 40)) * (rng.random((700, 40)) < 0.1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=x, where=norm > 0)[norm[:, 0] > 0]
    index = tx.BlockMaxIndex(x)
    for q in x[:60]:
        place, cosine = index.nearest(q, 7)
        exact = np.round(x.astype(np.float32).astype(float) @ q, 9)
        order = np.lexsort((np.arange(len(x)), -exact))[:7]
        order = order[exact[order] > 0]
        assert place.tolist() == order.tolist()
        assert np.allclose(cosine, exact[order])


def test_terms_are_words_and_beginnings():
    row, code, count, names = tx.text_terms(pa.array(["Bad badly, bad", None, "", "ok"]))
    found = {(r, names[c].as_py()): n for r, c, n in zip(row.tolist(), code.tolist(), count.tolist(), strict=True)}
    assert found == {(0, "bad"): 2, (0, "badly"): 1, (0, "badl*"): 1, (0, "badly*"): 1, (3, "ok"): 1}


@pytest.fixture()
def corpus(docs, frame, prose):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, prose(i, 30) + (" vile awful words" if bad else " kind words")))
        if i < 160:
            labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "vile awful"), (902, "vile awful"), (None, "kind words"), (903, "x" * 200_000)]
    labels += [(None, 1, 1), (5, None, None), (0, 1, 0)]
    return docs(rows), frame(labels, "doc_id long, quality int, toxic int")


def test_scores(corpus):
    docs, labels = corpus
    got = tx.scored(docs.withColumn("toxic_score", F.lit(9.0)), tx.fit(docs, labels)).collect()
    assert len(got) == 246
    by_id = {r.doc_id: r for r in got}
    for i in range(160, 240):
        assert (by_id[i].toxic_score >= tx.THRESHOLD) == (i % 4 == 0)
    assert by_id[900].toxic_score == by_id[901].toxic_score < 0.3
    assert [r.toxic_score >= 0.3 for r in got if r.doc_id == 902] == [True, True]
    assert by_id[902].toxic_evidence and all(e % 4 == 0 for e in by_id[902].toxic_evidence)
    assert all(0 <= r.toxic_score <= 1 for r in got)


def test_held_out_rows_are_not_learned_from(corpus):
    docs, labels = corpus
    learned = {r.doc_id for r in tx.learnable(labels).collect()}
    import zlib

    assert learned == {i for i in range(160) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_without_labels(docs, frame):
    none = frame([], "doc_id long, quality int, toxic int")
    some = docs([(1, "a b"), (2, None)])
    assert [r.toxic_score for r in tx.scored(some, tx.fit(some, none)).collect()] == [0.5, 0.5]
    one = frame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    many = docs([(i, f"text {i}") for i in range(20)])
    assert all(r.toxic_score < 0.3 for r in tx.scored(many, tx.fit(many, one)).collect())
    assert tx.scored(docs([]), tx.fit(docs([]), none)).count() == 0


def test_held_out_accuracy(spark, small):
    found = tx.op1_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.85 * len(rows)
