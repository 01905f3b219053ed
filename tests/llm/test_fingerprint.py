import hashlib

import numpy as np
import pyarrow as pa
import pytest

from wattquill.llm import fingerprint as fp
from wattquill.llm.common import Words


def test_equal_texts_have_equal_fingerprints(prose):
    texts = [prose(1, 300), prose(2, 300), prose(1, 300), "", None, prose(1, 300) + " more"]
    band = np.sort(np.unique(Words(pa.array(texts)).hashes()))
    a, b, c, d, e, f = fp.fingerprints(pa.array(texts), band)
    assert a == c != b and d == e
    assert fp.likeness(a, c) == 1.0 and fp.likeness(a, b) < 0.1
    assert fp.likeness(a, f) > 0.8
    assert fp.fingerprints(pa.array(texts[:1]), band) == [a]


def test_only_the_band_counts(prose):
    band = np.sort(Words(pa.array(["rare words here"])).hashes())
    x, y, z = fp.fingerprints(pa.array(["the rare words", "RARE, of words", "none of them"]), band)
    assert x == y != z


def test_lexicon(docs):
    rows = docs([(i, f"all {'half ' if i % 2 else ''}only{i} only{i}") for i in range(100)])
    found = set(fp.lexicon(rows, 0.02, 0.6).tolist())
    assert found == set(Words(pa.array(["half"])).hashes().tolist())


@pytest.mark.parametrize("per_bucket", [3, 1000])
def test_edited_texts(docs, prose, per_bucket):
    texts = {i * 3: prose(i, 5 + i * 7 % 90) for i in range(40)} | {121: None, 122: "", 123: "x", 124: "é" * 5}
    rows = docs(sorted(texts.items(), key=lambda r: r[0] % 7))
    plain = {i: t or "" for i, t in texts.items()}
    ids = sorted(plain)
    from wattquill.llm.common import with_text

    rows = with_text(rows)
    got = {r.doc_id: r for r in fp.compared(rows, fp.lexicon(rows), per_bucket).collect()}
    assert sorted(got) == ids
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(plain[i]) // 2
        edited = plain[i][: len(plain[i]) - half] + plain[after][:half]
        assert got[i].n_chars == len(plain[i])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == fp.likeness(got[i].fingerprint, got[after].fingerprint)
        assert got[i].near_edited == fp.likeness(got[i].fingerprint, got[i].edited_fingerprint)


def test_edges(docs):
    from wattquill.llm.common import with_text

    one = with_text(docs([(7, "single text")]))
    (r,) = fp.compared(one, fp.lexicon(one)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"singlesingl").hexdigest() or r.near_next == 1.0
    none = with_text(docs([]))
    assert fp.compared(none, fp.lexicon(none)).count() == 0
    same = with_text(docs([(1, "a b"), (1, "a b"), (None, "c"), (2, "d")]))
    got = fp.compared(same, fp.lexicon(same), 1).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2]
