import re

import pytest
from pyspark.sql import functions as F

from wattquill.llm import pii


def plain_base(text):
    """The patterns as they are written, with the plain engine."""
    found = []
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * 2 for d in digits[-2::-2]]
            total = sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in double)
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


TEXTS = [
    "", "no data", "a@b.co, x@y@z.com a@b a@@b.c", "me.you+z%x-1@mail-2.example.co.uk.",
    "1.2.3.4 1.2.3.4.5 300.1.1.1 1.2.3 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112",
    "+1 (269) 555-3296 4524132264652876", "+12345678901 +1 2 +999", "x4111111111111111y 12--34", "é@é.fr q@w.é",
    "1" * 60, "+1" * 30, "a" * 50 + "@" + "b.c" * 10,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_patterns_on_given_texts(spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        assert pii.base_spans(r.text) == plain_base(r.text)


@pytest.fixture(scope="module")
def field():
    return pii.trained([])


def brute_force(field, n, found):
    """The highest total over all segmentations."""
    def best(at, before):
        if at == n:
            return 0.0
        options = [field.step(before, "O") + best(at + 1, "O")]
        options += [field.step(before, k) + field.rate(f) + best(j, k) for i, j, k, f in found if i == at]
        return max(options)

    return best(0, "O")


@pytest.mark.parametrize("text", ["+1 (269) 555-3296 4524132264652876", "555-3296 1.2.3.4 12", "bob (at) mail dot com"])
def test_decoding_is_the_best_segmentation(field, text):
    a, b = next(pii.runs(text))
    tokens, found = pii.candidates(text, a, b)
    chosen = field.best(len(tokens), found)
    total, at, before = 0.0, 0, "O"
    for i, j, kind, features in chosen:
        for _ in range(at, i):
            total, before = total + field.step(before, "O"), "O"
        total, at, before = total + field.step(before, kind) + field.rate(features), j, kind
    for _ in range(at, len(tokens)):
        total, before = total + field.step(before, "O"), "O"
    assert total == pytest.approx(brute_force(field, len(tokens), found))


def test_the_field_adds_what_patterns_miss(field):
    def spans(text):
        return [(k, text[a:b]) for k, a, b in pii.all_spans(text, pii.base_spans(text), field)]

    assert spans("see +1 (269) 555-3296 4524132264652876 now") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert spans("write bob (at) mail dot com today") == [("email", "bob (at) mail dot com")]
    assert spans("ring (269) 555-3296 now") == [("phone", "(269) 555-3296")]
    assert spans("in 2001-12-30 we had 1234567890 and 3.14.15") == []
    assert spans("at home a dot is a dot") == []


@pytest.mark.parametrize("address", ["john@example dot com", "john@example[dot]com", "john at example.com", "john@example(dot)com", "JOHN AT EXAMPLE.COM", "john at example.com"])
def test_runs_do_not_depend_on_the_rest(field, address):
    alone = f"so {address} it is"
    other = " or an anecdote (at) home @ [at] noon, . dot"
    found = [pii.all_spans(t, [], field) for t in (alone, alone + other)]
    assert [s for s in pii.runs(alone)] == [s for s in pii.runs(alone + other) if s[1] <= len(alone)]
    assert found[0] == [s for s in found[1] if s[2] <= len(alone)]
    assert [m.span() for m in pii.SPELLED.finditer(alone)] == list(pii.runs(alone))


def test_mixed_ways_to_write_an_address(field):
    for address in ("john@example dot com", "john@example[dot]com"):
        assert [(k, a, b) for k, a, b in pii.all_spans(f"write {address} today", [], field)] == [("email", 6, 6 + len(address))]


def test_generated_examples_are_found(field):
    right = total = 0
    for text, gold in pii.generated(300, seed=99):
        found = pii.all_spans(text, pii.base_spans(text), field)
        right += len(set(gold) & set(found))
        total += len(gold)
    assert right >= 0.93 * total


def test_frames(spark, docs, field):
    rows = docs([(1, None), (2, ""), (3, "a@b.co and +1 (269) 555-3296"), (3, "a@b.co and +1 (269) 555-3296"), (None, "1.2.3.4"), (4, "a" * 300_000 + " 1" * 1000)])
    got = pii.found_spans(rows.withColumn("pii_spans", F.lit("x")), field).collect()
    spans = [(r.doc_id, r.pii_spans) for r in got]
    assert spans == [(1, ""), (2, ""), (3, "email:0:6,phone:11:28"), (3, "email:0:6,phone:11:28"), (None, "ip:0:7"), (4, "")]
    clean = pii.found_spans(rows, field, redact=True)
    assert clean.columns == rows.columns
    assert [(r.text, r.n_chars) for r in clean.collect()][:3] == [(None, None), ("", 0), ("[EMAIL] and [PHONE]", 19)]
    assert pii.found_spans(docs([]), field).count() == 0


def test_query(spark, small):
    got = {r.doc_id: r for r in pii.op2_pii(spark, small).collect()}
    import hashlib

    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        base = plain_base(r.text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert got[r.doc_id].n_email == sum(k == "email" for k, _, _ in base)
        assert set(filter(None, listed.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_long_parts_of_addresses():
    field = pii.trained([])
    for local, host in (("a" * 70, "example"), ("jane", "h" * 80), ("jane.roe", "one dot two dot three dot four dot five")):
        text = f"write to {local} at {host} dot com today"
        assert any(k == "email" and text[a:b].startswith(local) for k, a, b in pii.all_spans(text, pii.base_spans(text), field))


def test_many_spans_take_linear_time():
    """A text of a megabyte that holds little but personal data."""
    import time

    field = pii.trained([])
    unit = "jo@mail.com 10.0.0.1 +1 (269) 555-3296 4111 1111 1111 1111x a at b dot com, "

    def seconds(times):
        begun = time.process_time()
        text = unit * times
        base = pii.base_spans(text)
        spans = pii.all_spans(text, base, field)
        assert set(base) <= set(spans) and sum(k == "email" for k, _, _ in base) == times
        return time.process_time() - begun

    few, many = seconds(1_700), seconds(13_600)
    assert many < 16 * few + 5


def test_added_spans_keep_off_all_others():
    field = pii.trained([])
    text = "call 555 123 4567 or jo at mail dot com, 10.0.0.1 and +1 (269) 555-3296 4524132264652876 " * 30
    base = pii.base_spans(text)
    added = [s for s in pii.all_spans(text, base, field) if s not in base]
    places = sorted(s[1:] for s in added)
    assert all(x[1] <= y[0] for x, y in zip(places, places[1:], strict=False))
    assert all(b <= s or a >= e for _, a, b in added for _, s, e in base)
