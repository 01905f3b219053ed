"""The pipeline's stages on a small table, each against a plain version of it."""

import re

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from wattquill.llm import mixing, pii, toxicity
from wattquill.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, FOLDER, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    raw, clean, unique, private, mixed, packed = steps
    for df in (clean, unique, private, mixed):
        assert df.columns == raw.columns
    model = toxicity.fit(raw, table(spark, FOLDER, "labels"))
    bad = toxicity.scored(raw, model).filter("toxic_score >= 0.3")
    assert ids(clean) == sorted(set(ids(raw)) - set(ids(bad)))

    def shingles(text):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    rows = sorted((r.doc_id, shingles(r.text)) for r in clean.collect())
    kept = set(ids(unique))
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    for i, s in rows:
        near = [j for j, t in rows if j != i and alike(s, t)]
        assert i in kept or near
        assert not (i in kept and any(j in kept for j in near))
    field = pii.fit(unique)
    before = {r.doc_id: r.text for r in unique.collect()}
    for r in private.collect():
        text = before[r.doc_id]
        assert r.text == pii.redacted(text, pii.all_spans(text, pii.base_spans(text), field))
        assert r.n_chars == len(r.text)
    assert ids(mixed) == ids(mixing.sampled(private))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids(mixed))


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER)
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, steps[-1].select(keys).collect()))


def test_registered():
    names = [n for n in driver.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in driver.queries()
