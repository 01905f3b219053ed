import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from wattquill.llm import crosstokens
from wattquill.llm.registry import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    # bytes of each A token by the byte-level alphabet of the vocabulary itself
    alphabet = crosstokens.byte_level()
    b = SentencePieceProcessor(model_file=B)

    def pieces(text):
        left = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in left]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else b"" if i < 3 else p.replace("▁", " ").encode()))
        return left, right

    return pieces


def plain(rows, pieces):
    docs = []
    for doc_id, text in rows:
        wanted = b" " + (text or "").encode()
        left, right = pieces(text or "")
        if not text or b"".join(t for _, t in left) != wanted or b"".join(t for _, t in right) != wanted:
            docs.append((doc_id, [], [], []))
            continue
        ends = []
        for side in (left, right):
            at = 0
            ends.append([at := at + len(t) for _, t in side])
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, s = [], 0
        for e in common:
            groups.append(
                (
                    [i for (i, _), x in zip(left, ends[0]) if s < x <= e],
                    [i for (i, _), x in zip(right, ends[1]) if s < x <= e],
                )
            )
            s = e
        docs.append((doc_id, left, right, groups))
    found = [[(a, b) for ga, gb in groups for a in ga for b in gb] for *_, groups in docs]
    count = Counter(p for links in found for p in set(links))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc_id, left, right, groups), links in zip(docs, found):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (
                doc_id,
                len(left),
                len(right),
                len(groups),
                len(links),
                hashlib.sha256(text.encode()).hexdigest() if left else "",
                sum(count[p] == best[p[0]] for p in links),
                sum(count[p] for p in links),
            )
        )
    return out


def same(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_query_equals_the_plain_version(spark, small, tokenizers):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    same(queries()["op11_crosstokens"](spark, small).collect(), plain(docs, tokenizers))


def test_odd_texts_in_small_blocks(spark, docs, tokenizers):
    rows = [
        (1, None),
        (2, ""),
        (3, " "),
        (4, "a▁b"),
        (5, "<|endoftext|> and <s> </s>"),
        (6, "日本語のテキスト、ไทย, العربية 🤖🤖🤖 \x00\x01"),
        (7, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa aaa aa"),
        (8, "tabs\t\tand   spaces \n\n ends  "),
        (9, "İı ﬁ Å é ½"),
        (None, "no id here"),
        (10, "word " * 20_000),
        (11, "=" * 5000 + "ᚠᛇᚻ" * 500),
    ]
    rows += [(20 + n % 5, "the same text twice, Verschiedenheit") for n in range(60)]
    df = docs(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "n_best")
    found = crosstokens.cross_tokens(df, A, B, block_bytes=300).collect()
    same(found, plain(rows, tokenizers))


def test_chunks_of_a_large_group_change_nothing(spark, docs, tokenizers, monkeypatch):
    rows = [(1, "ᚠᛇᚻ日本語テキスト" * 40), (2, "zweite Überraschungsmöglichkeiten")]
    pair = crosstokens.Pair(A, B)
    for chunk in (1, 7, 10**6):
        monkeypatch.setattr(crosstokens, "CHUNK", chunk)
        a, a_n, b, _ = pair.encode([t for _, t in rows])
        import numpy as np

        row = np.repeat([0, 1], a_n)
        groups = crosstokens.Groups(pair, a, row, b)
        got = [x.tolist() for x in crosstokens.links(pair, a, b, groups, 2)]
        if chunk == 1:
            first = got
        assert got == first
    assert np.bincount(got[0], got[2]).tolist() == [r[4] for r in plain(rows, tokenizers)]


def test_empty_table(spark, docs):
    assert crosstokens.cross_tokens(docs([]), A, B).collect() == []


class Frame:
    """Takes the function that a frame's tasks would run."""

    def mapInArrow(self, run, ddl):
        self.run = run
        return self


def test_a_block_is_worked_through_in_parts_with_one_list(monkeypatch, prose):
    import gc
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(crosstokens, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = [(k, prose(k, 60) + " Überraschungsmöglichkeiten " + prose(k % 7, 40)) for k in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]})
    assert 2_000_000 < sum(len(t) for _, t in rows) < crosstokens.BLOCK_BYTES
    run = crosstokens.aligned(Frame(), A, B).run
    list(run(iter([batch.slice(0, 5)])))  # the vocabularies are loaded
    gc.collect()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        kinds = [k for out in run(iter([batch])) for k in out.column("kind").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert kinds == ["text"] * 4000 + ["list", "vector"]
    print(f"{peak / 1e6:.0f} MB at the peak")
    assert peak < 150_000_000


def test_places_of_a_list_are_kept_as_it_grows():
    import random

    import numpy as np

    rng = random.Random(1)
    listed, count = crosstokens.Listed(), Counter()
    seen = []
    for _ in range(20):
        pairs = [p for _ in range(5) for p in rng.sample(range(-50, 50), rng.randint(0, 30))]
        count.update(pairs)
        seen.append((pairs, listed.places(np.array(pairs, np.int64))))
    ids = listed.ids().tolist()
    assert dict(zip(ids, listed.texts.tolist(), strict=True)) == count and len(ids) == len(count)
    assert all([ids[p] for p in places.tolist()] == pairs for pairs, places in seen)
