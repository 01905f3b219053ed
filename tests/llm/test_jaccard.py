import itertools
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattquill.llm import jaccard as jc
from wattquill.llm.components import components


def shingle_set(text):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_force(rows):
    """Links and classes of (id, text) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) >= 0.8 * union - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    lowest = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted((str(rows[k][0]), str(lowest[find(k)]), links[k]) for k in range(len(rows)))


def changed(text, every, word):
    words = text.split()
    words[::every] = [word] * len(words[::every])
    return " ".join(words)


@pytest.fixture()
def rows(prose):
    out = []
    for k in range(6):
        base = prose(k, 120)
        out += [(10 * k, base), (10 * k + 1, base), (10 * k + 2, base + " and more"), (10 * k + 3, changed(base, 60, "zz"))]
        out += [(10 * k + 4, prose(100 + k, 120)), (10 * k + 5, changed(base, 12, "qq"))]
    hot = prose(77, 200)
    for k in range(60):
        words = hot.split()
        words[(7 * k) % 190 : (7 * k) % 190 + 1 + k % 3] = [f"w{k}"]
        out.append((1000 + k, " ".join(words)))
    out += [(2000, None), (2001, ""), (2002, "!!"), (2003, "three short words"), (2004, "Three short, words"), (2005, "one")]
    out += [(None, prose(0, 120)), (None, prose(500, 30)), (7, prose(501, 40)), (7, prose(501, 40)), (7, prose(502, 40))]
    return out


@pytest.mark.parametrize("block", [8, 512])
def test_join_equals_brute_force(docs, rows, block):
    got = jc.linked(docs(rows), block=block).collect()
    found = sorted((str(None if r.key == jc.NO_ID else r.key), str(r.class_id), r.n_links) for r in got)
    assert found == brute_force(rows)


def test_stage_keeps_one_of_each_class(spark, docs, rows):
    df = docs(rows).withColumn("_node", F.lit("mine")).withColumn("key", F.lit(1))
    kept = jc.stage(spark, df, "")
    assert kept.columns == df.columns
    classes = {c for _, c, _ in brute_force(rows)}
    got = kept.collect()
    assert len(got) >= len(classes) - 1
    ids = [r.doc_id for r in got]
    assert {str(i) for i in ids} >= classes - {"None"}
    assert ids.count(None) == 1 and all(r["_node"] == "mine" for r in got)


def test_prefix_is_shortened_until_the_recall_is_met():
    assert jc.prefix_length(0.8) == 4
    assert jc.prefix_length(0.95) > 4
    assert jc.prefix_length(0.3) == 1


def test_empty_table(spark, docs):
    assert jc.linked(docs([])).count() == 0
    assert jc.stage(spark, docs([]), "").count() == 0


def test_long_text(docs, prose):
    long = prose(1, 40_000)
    got = jc.linked(docs([(1, long), (2, long + " end"), (3, "x y z")])).collect()
    assert sorted((r.key, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_shingles_of_short_texts():
    row, run = jc.shingles(pa.array(["a b c", "A, b; c", "", None, "a b c d e", "a b c d e f a b c d e"]))
    assert row.tolist() == [0, 1, 4, 5, 5, 5, 5, 5, 5] or row.tolist().count(5) in (6, 7)
    assert run[0] == run[1]


def test_components(frame):
    chain = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 150), (201, 150), (201, 202)]
    got = {r.node: r.root for r in components(frame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 150: 150, 200: 150, 201: 150, 202: 150}
    assert components(frame([], "a long, b long")).count() == 0
