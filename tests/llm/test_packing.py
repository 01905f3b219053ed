import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from wattquill.llm import packing as pk


def expanded(plan):
    """Sequences of the plan: number to (offset, length) pairs."""
    out = defaultdict(list)
    for length, _, count, sequence, offset in plan.rows:
        for k in range(count):
            out[sequence + k].append((offset, length))
    return out


def checked(lengths, capacity):
    plan = pk.Plan(dict(Counter(lengths)), capacity)
    ranks = Counter()
    for length, first, count, _, _ in plan.rows:
        assert first == ranks[length]
        ranks[length] += count
    assert ranks == Counter(lengths)
    sequences = expanded(plan)
    assert len(sequences) == plan.sequences
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.sequences


def optimum(lengths, capacity):
    """Fewest sequences, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            rooms.remove(room)
            rooms.append(room - lengths[k])
            put(k + 1, rooms)
            rooms.remove(room - lengths[k])
            rooms.append(room)
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.randint(10, 40)
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
    fixed = pk.Plan.__new__(pk.Plan)
    fixed.capacity, fixed.used, fixed.rows, fixed.sequences = capacity, {}, [], 0
    fixed.left = dict(sorted(Counter(lengths).items()))
    fixed.reduce()
    rest = [n for n, count in fixed.left.items() for _ in range(count)]
    assert fixed.sequences + (optimum(rest, capacity) if rest else 0) == optimum(lengths, capacity)
    assert checked(lengths, capacity) <= optimum(lengths, capacity) + 1


@pytest.mark.parametrize("seed", range(5))
def test_large_plans(seed):
    rng = random.Random(seed)
    lengths = [min(2048, int(rng.expovariate(1 / 700)) + 1) for _ in range(20_000)]
    used = checked(lengths, 2048)
    assert used <= -(-sum(lengths) // 2048) * 1.01 + 1
    checked([2048] * 10 + [1025] * 7, 2048)
    assert checked([], 2048) == 0


def test_encoder_equals_whole_texts():
    path = public_tokenizers.path(pk.TOKENIZER)
    encoder = pk.Encoder(path)
    texts = ["Hello, world's end\n\nNEW  line\t tab", "", "<|endoftext|> x", "ΣΑΣ, ßé 123 é '", " lead", "don't we'll"]
    ids, sizes = encoder.encode(pa.array(texts))
    whole = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == list(itertools.chain(*whole))
    assert sizes.tolist() == [len(x) for x in whole]


def test_packed_documents(spark, docs, prose):
    rows = [(k, prose(k, 5 + 37 * k % 400)) for k in range(60)] + [(100, None), (101, ""), (102, prose(9, 9000)), (7, "same"), (7, "same"), (None, "x")]
    path = public_tokenizers.path(pk.TOKENIZER)
    got = pk.packed(pk.pieces(docs(rows).fillna("", "text"), path), rows_per_bucket=7).collect()
    tokenizer = pk.Encoder(path).tokenizer
    expected = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.append((i or -1, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted((i if i else (0 if i == 0 else -1), *x) if i else (-1, *x) for i, *x in expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 2048) + 1
    assert pk.packed(pk.pieces(docs([]), path)).count() == 0
