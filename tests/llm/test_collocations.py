import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from wattquill.llm import collocations
from wattquill.llm.collocations import Packing
from wattquill.llm.registry import oracle_sql, queries

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, most=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, text or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for mark in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(mark, "\n")
        for piece in lowered.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i : i + size])
                    counts[key] = counts.get(key, 0) + 1
    often = {k: n for k, n in counts.items() if n >= least}
    covered = set()
    for (lang, words), n in often.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * n >= 100 * counts[lang, words[i : i + size]]:
                    covered.add((lang, words[i : i + size]))
    out = []
    for (lang, words), a in often.items():
        if len(words) < 2 or (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(words), a, l, r, totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:most], 1)]
    return sorted(ranked)


@pytest.mark.parametrize(("length", "bits"), [(2, 1), (2, 15), (3, 21), (5, 12), (5, 13), (5, 25), (4, 32), (5, 33), (3, 60)])
@pytest.mark.parametrize("section_bits", [0, 1, 5])
def test_filters_keep_everything(length, bits, section_bits):
    rng = np.random.default_rng(length * 100 + bits)
    packing = Packing(length, bits)
    ids = rng.integers(1, 2**bits, 4000) if bits > 1 else np.ones(4000, np.int64)
    limbs, order, first = packing.distinct(packing.pack(ids, collocations.runs_of(ids, length)))
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], len(first))
    section_bits = min(section_bits, packing.width)
    section = packing.section(limbs, section_bits)
    for s in np.unique(section):
        own = section == s
        raw = packing.filter([x[own] for x in limbs], counts[own], section_bits)
        values, again = packing.values(raw, int(s), section_bits)
        assert all((x[own] == y).all() for x, y in zip(limbs, values)) and (again == counts[own]).all()
    expected = {tuple(ids[i : i + length].tolist()) for i in range(len(ids) - length + 1)}
    unpacked = packing.unpack(limbs).tolist()
    assert len(unpacked) == len(expected) and set(map(tuple, unpacked)) == expected


def test_runs_left_are_those_with_frequent_parts():
    rng = random.Random(5)
    for _ in range(300):
        ids = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 30))], np.uint32)
        length = rng.randint(2, 4)
        starts = collocations.runs_of(ids, length)
        keep = starts[[rng.random() < 0.7 for _ in starts]] if len(starts) else starts
        out = collocations.without_gaps(ids, keep, length)
        expected = [ids[i : i + length + 1].tolist() for i in keep if i + 1 in set(keep.tolist())]
        assert [out[i : i + length + 1].tolist() for i in collocations.runs_of(out, length + 1)] == expected


def test_query_equals_sql(spark, small):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{small}/documents.parquet'")
    expected = db.sql(oracle_sql()["op12_collocations"]).fetchall()
    found = queries()["op12_collocations"](spark, small).select(*NAMES).collect()
    assert len(expected) > 20
    assert sorted(map(tuple, found)) == sorted(expected)


def test_small_blocks_and_sections_odd_texts(spark, frame, monkeypatch):
    monkeypatch.setattr(collocations, "SECTION_BYTES", 500)
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "ÀB", "àb", "İx", "x\x00y", "z w", "日本", "'s", "b"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, "..."), ("fr", "one two three four five six " * 900), ("fr", "a " * 3000)]
    df = frame([(l, t, "x", 1) for l, t in rows], "lang string, text string, words string, block int")
    found = collocations.phrases(df, least=4, block_bytes=700).select(*NAMES).collect()
    assert sorted(map(tuple, found)) == plain(rows, 4)
    few = collocations.phrases(df, least=4, most=3).select(*NAMES).collect()
    assert sorted(map(tuple, few)) == plain(rows, 4, 3)


def test_products_beyond_64_bits(spark, frame):
    score = frame([(3 * 10**12, 10**13, 4 * 10**12, 7 * 10**12 + 1)], "a long, n long, l long, r long").selectExpr(
        "(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as s"
    )
    assert score.first()["s"] == 1000 * 3 * 10**12 * 10**13 // (4 * 10**12 * (7 * 10**12 + 1))


def test_empty_table(spark, frame):
    empty = frame([], "lang string, text string")
    assert collocations.phrases(empty).collect() == []
