import math

import pytest
from pyspark.sql import functions as F

from wattquill.llm import voronoi as vo

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=5):
    vectors = [
        (i, [math.floor(float(x) * 256) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in vectors if i % 50 == 0}):
        own = min(v for i, v in vectors if i == q)
        products = [(sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in vectors if i != q]
        scores = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for s, i in products)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def answer(frame, rows, **how):
    df = frame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in vo.top_k(vo.scaled(df), F.col("vec_id") % 50 == 0, **how).collect())


@pytest.mark.parametrize("how", [{}, {"pivots": 3, "slice_rows": 7}, {"pivots": 1}])
def test_equals_brute_force(frame, how):
    import random

    rng = random.Random(1)
    centres = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(5)]
    f32 = lambda x: math.ldexp(round(math.ldexp(x, 12)), -12)  # noqa: E731  exact as float
    rows = [(i, [f32(c + rng.gauss(0, 0.1)) for c in centres[i % 5]]) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)]
    rows += [(700, None), (701, [None, 1.0]), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (None, [1.0] * 6)]
    rows += [(750, [0.25] * 6), (750, [0.25] * 6), (751, [2.0, 1.0]), (752, [1.0] * 8)]
    assert answer(frame, rows, **how) == brute_force(rows)


def test_few_rows(frame):
    assert answer(frame, []) == []
    assert answer(frame, [(50, [1.0, 2.0])]) == []
    assert answer(frame, [(50, [1.0]), (51, [-1.0]), (100, [0.5])]) == brute_force([(50, [1.0]), (51, [-1.0]), (100, [0.5])])


def test_large_components_stay_exact(frame):
    rows = [(50 * i, [30000.0 * (i + 1), -29999.5, 0.00390625]) for i in range(8)]
    assert answer(frame, rows) == brute_force(rows)


def test_every_finite_vector_takes_part(frame):
    """Components beyond 32, 53 and 64 bits beside small ones; float holds these values as they are."""
    rows = [(50, [1e7, 1.0, -0.5]), (51, [1e7, 3.0, 0.25]), (52, [-1.0, 2.0, 0.0]), (100, [0.5, 0.5, 0.5])]
    rows += [(53, [2.0**40, 1.0, 1.0]), (54, [-(2.0**40), 1.0, 2.0]), (150, [2.0**50, 1.0, 0.0]), (55, [2.0**120, 0.0, 1.0])]
    rows += [(200, [0.0, 2.0**-8, 2.0**-8]), (56, [0.0, 2.0**60, -(2.0**60)]), (250, [2.0**100] * 3)]
    for how in ({}, {"pivots": 2, "slice_rows": 3}):
        assert answer(frame, rows, **how) == brute_force(rows)


def test_repeated_rows_and_many_queries(frame):
    """More copies of one row than a slice has room for, and more queries than a block."""
    rows = [(7, [1.0, 1.0])] * 300 + [(7, [1.0, 0.5])] * 3 + [(50 * k, [float(k % 7), 1.0]) for k in range(600)]
    assert answer(frame, rows, pivots=3, slice_rows=50) == brute_force(rows)


def test_products_of_every_size():
    import random

    rng = random.Random(3)
    for top in (2**10, 2**26, 2**31, 2**52):
        q = [[float(rng.randint(-top, top)) for _ in range(4)] for _ in range(5)]
        x = [[float(rng.randint(-(2**r), 2**r)) for _ in range(4)] for r in (3, 20, 40, 52, 53)]
        import numpy as np

        got = vo.exact_products(np.array(q), np.array(x)).tolist()
        exact = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
        assert got == [[min(max(s, -(2**63)), 2**63 - 1) for s in r] for r in exact]
