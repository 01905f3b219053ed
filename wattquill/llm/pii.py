"""Personal data in texts: base patterns, and a semi-Markov conditional random field for the rest.

The base patterns are email, ip, card and phone, leftmost and non-overlapping per kind; a match that
fails its check is dropped. The field works on the runs of a text that could hold more: runs of
digits and number punctuation, and addresses written with `at` and `dot`. A run is cut into tokens;
each token sequence of at most `MOST_TOKENS` that has the makings of a kind is a candidate segment, whatever its tokens' lengths,
rated as a whole (its shape, digit count, check digit, separators, neighbours). A dynamic program
over the run then chooses the segmentation with the highest total of segment and transition
weights, so that boundaries and kinds are chosen together: `+1 (269) 555-3296 4524132264652876` is a
phone and a card, though either base pattern runs through both and drops its match. Segments never
overlap a base span; base spans stay as they are.

The weights maximise the likelihood of segmentations with a small penalty (stochastic gradient,
forward-backward), over generated examples and over runs of at most `SAMPLE_ROWS` texts whose base
spans are the labels. The model has a fixed size.

Defined cases: a null text is an empty one and has no span; texts are read whole, in time linear in
their length; repeated rows give repeated results. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.llm.common import slices, table, texts_of, with_text

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 20
SAMPLE_ROWS = 2000
GENERATED = 600
EPOCHS = 4

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits unless one begins with it: the look-behind changes
# no match and keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Matches of the email pattern, from each `@` outward: no run is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield "email", start, match.end()
        done = match.end() if match else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By start, then kind."""
    found = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Runs of a text that the field looks at

NUMBERS = re.compile(r"[0-9+(][0-9 ().+-]*+")
AT = r"(?:@|\(at\)|\[at\]|\bat\b)"
DOT = r"(?:\.|\(dot\)|\[dot\]|\bdot\b)"
SPELLED = re.compile(
    rf"(?<![\w.+-])[\w.+-]++ ?{AT} ?[\w-]++(?: ?{DOT} ?[\w-]++)+", re.I
)
TOKEN = re.compile(r"\w+|[^\w]")
LABELS = ("O", *KINDS)


# a cheap look before the pattern of written-out addresses: what each match has, and may be elsewhere
AT_MARKS = ("@", "at")
DOT_MARKS = (".", "dot")


def runs(text: str) -> Iterator[tuple[int, int]]:
    for m in NUMBERS.finditer(text):
        if m.end() - m.start() > 6:
            yield m.start(), m.end()
    lower = text.lower()
    if any(m in lower for m in DOT_MARKS) and any(m in lower for m in AT_MARKS):
        for m in SPELLED.finditer(text):
            yield m.start(), m.end()


def side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() or c == "_" else "space" if c.isspace() else c


Candidate = tuple[int, int, str, tuple[str, ...]]


def candidates(text: str, first: int, last: int) -> tuple[list[tuple[int, int]], list[Candidate]]:
    """Tokens of a run (as places in the text), and its candidate segments with their features."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, first, last)]
    found: list[Candidate] = []
    spelled = any(c.isalpha() for c in text[first:last])
    for i, (start, _) in enumerate(tokens):
        c = text[start]
        if spelled:
            if c.isalnum() or c == "_":
                for j in range(i + 4, min(len(tokens), i + MOST_TOKENS)):
                    end = tokens[j][1]
                    if text[end - 1].isalnum():
                        if features := email_features(text, start, end, i == 0, j == len(tokens) - 1):
                            found.append((i, j + 1, "email", features))
            continue
        if not ("0" <= c <= "9" or c in "+(") or side(text, start - 1) in ("digit", "letter"):
            continue
        digits = 0
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            a, b = tokens[j]
            if not "0" <= text[a] <= "9":
                if j > i and text[a] == "+":
                    break
                continue
            digits += b - a
            if digits > 19:
                break
            if digits >= 4 and side(text, b) not in ("digit", "letter"):
                found += number_features(text, start, b, i, j + 1, digits)
    return tokens, found


def shape(part: str) -> str:
    return re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>", part)


def number_features(text: str, a: int, b: int, i: int, j: int, n: int) -> list[Candidate]:
    part = text[a:b]
    groups = re.split(r"[^0-9]+", part.strip("+("))
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", part)))) or "none"
    around = (f"left {side(text, a - 1)}", f"right {side(text, b)}")
    open_ = "unbalanced" if part.count("(") != part.count(")") else "balanced"
    out: list[Candidate] = []
    if len(groups) == 4 and part.replace(" ", "").count(".") == 3 and set(part) <= set("0123456789. "):
        ok = all(1 <= len(g) <= 3 and int(g) <= 255 for g in groups)
        out.append((i, j, "ip", ("ip", f"ip octets {ok}", f"ip marks {marks}", *(f"ip {x}" for x in around))))
    if 13 <= n <= 19 and set(part) <= set("0123456789 .-"):
        ok = luhn(digits_of(part))
        even = len({len(g) for g in groups[:-1]}) <= 1 and min(map(len, groups)) >= 3
        out.append((i, j, "card", ("card", f"card luhn {ok}", f"card digits {n}", f"card even {even}", f"card marks {marks}", *(f"card {x}" for x in around))))
    if 7 <= n <= 15:
        plus = part.startswith("+")
        sizes = "-".join(str(len(g)) for g in groups[-3:])
        out.append((i, j, "phone", ("phone", f"phone plus {plus}", f"phone digits {n}", f"phone plus {plus} digits {n}", f"phone shape {shape(part)}", f"phone groups {sizes}", f"phone number of groups {min(len(groups), 6)}", f"phone marks {marks}", f"phone {open_}", *(f"phone {x}" for x in around))))
    return out


ADDRESS = re.compile(rf"([\w.+-]+) ?({AT}) ?([\w-]+(?: ?{DOT} ?[\w-]+)+)", re.I)


def email_features(text: str, a: int, b: int, whole_left: bool, whole_right: bool) -> tuple[str, ...]:
    m = ADDRESS.fullmatch(text, a, b)
    if not m:
        return ()
    dots = {d.lower() for d in re.findall(DOT, m[3], re.I)}
    ending = re.findall(r"[\w-]+", m[3])[-1]
    known = ending.lower() in ("com", "org", "net", "edu", "de", "fr", "es", "io")
    return (
        "email",
        f"email at {m[2].lower()}",
        *(f"email dot {d}" for d in sorted(dots)),
        f"email at {m[2].lower()} dot {'.' if dots == {'.'} else 'word'}",
        f"email ending {min(len(ending), 6)} {ending.isalpha()}",
        f"email known ending {known}",
        f"email all left {whole_left}",
        f"email all right {whole_right}",
    )


class Field:
    """Weights of the features of a segment and of the kinds that follow each other."""

    def __init__(self):
        self.weight: dict[str, float] = defaultdict(float)

    def rate(self, features: tuple[str, ...]) -> float:
        w = self.weight
        return sum(w.get(f, 0.0) for f in features)

    def step(self, before: str, kind: str) -> float:
        return self.weight.get(f"{before} then {kind}", 0.0)

    def arcs(self, n: int, found: list[Candidate]) -> list[list[tuple[int, str, float, int]]]:
        """For each end: start, kind, weight and candidate of the segments that end there."""
        ends: list[list[tuple[int, str, float, int]]] = [[] for _ in range(n + 1)]
        for j in range(1, n + 1):
            ends[j].append((j - 1, "O", 0.0, -1))
        for c, (i, j, kind, features) in enumerate(found):
            ends[j].append((i, kind, self.rate(features), c))
        return ends

    def best(self, n: int, found: list[Candidate]) -> list[Candidate]:
        """The segments of the best segmentation; of equally good ones the first found."""
        score: list[dict[str, tuple[float, int, str, int]]] = [{"O": (0.0, -1, "", -1)}]
        for j, arcs in enumerate(self.arcs(n, found)[1:], 1):
            here: dict[str, tuple[float, int, str, int]] = {}
            for i, kind, weight, c in arcs:
                for before, (total, *_) in score[i].items():
                    value = total + weight + self.step(before, kind)
                    if kind not in here or value > here[kind][0]:
                        here[kind] = value, i, before, c
            score.append(here)
        kind = max(score[n], key=lambda k: score[n][k][0])
        out, j = [], n
        while j > 0:
            _, i, before, c = score[j][kind]
            if c >= 0:
                out.append(found[c])
            j, kind = i, before
        return out[::-1]

    def learn(self, n: int, found: list[Candidate], gold: set[int], rate: float) -> None:
        """One gradient step on the likelihood of the segmentation whose candidates are `gold`."""
        ends = self.arcs(n, found)
        forward: list[dict[str, float]] = [{"O": 0.0}]
        for arcs in ends[1:]:
            here: dict[str, list[float]] = defaultdict(list)
            for i, kind, weight, _ in arcs:
                here[kind] += [v + weight + self.step(b, kind) for b, v in forward[i].items()]
            forward.append({k: log_sum(v) for k, v in here.items()})
        back: list[dict[str, list[float]]] = [defaultdict(list) for _ in range(n + 1)]
        closed: list[dict[str, float]] = [{} for _ in range(n + 1)]
        closed[n] = {k: 0.0 for k in forward[n]}
        total = log_sum(list(forward[n].values()))
        change: dict[str, float] = defaultdict(float)
        for j in range(n, 0, -1):
            if j < n:
                closed[j] = {k: log_sum(v) for k, v in back[j].items()}
            for i, kind, weight, c in ends[j]:
                after = closed[j].get(kind)
                if after is None:
                    continue
                for before, v in forward[i].items():
                    t = weight + self.step(before, kind) + after
                    back[i][before].append(t)
                    p = math.exp(min(0.0, v + t - total))
                    change[f"{before} then {kind}"] -= p
                    if c >= 0:
                        for f in found[c][3]:
                            change[f] -= p
        at, before = 0, "O"
        chosen = {found[c][0]: c for c in gold}
        while at < n:
            c = chosen.get(at, -1)
            kind = found[c][2] if c >= 0 else "O"
            change[f"{before} then {kind}"] += 1
            if c >= 0:
                for f in found[c][3]:
                    change[f] += 1
            at, before = (found[c][1] if c >= 0 else at + 1), kind
        for f, d in change.items():
            self.weight[f] += rate * (d - 0.002 * self.weight[f])


def log_sum(values: list[float]) -> float:
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def generated(count: int, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with spans of every kind, in the usual ways to write them, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def card() -> str:
        body = rng.choice("345") + digits(rng.choice((13, 14, 14, 14, 15)))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = rng.choice(("", "", " ", "-", "."))
        return mark.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        plain = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"))
        code = f"+{rng.choice(('1', '1', '1', '33', '34', '44', '49'))}"
        return plain if rng.random() < 0.3 else f"{code}{rng.choice(' -')}{plain}"

    def email() -> str:
        at = rng.choice((" at ", " (at) ", " [at] ", "(at)", "[at]", " @ "))
        dot = rng.choice((" dot ", " (dot) ", "[dot]", " [dot] ")) if at not in ("(at)", " @ ") else rng.choice((".", " dot "))
        return f"{word()}{rng.choice(('', '.' + word()))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    makers = {"card": card, "phone": phone, "email": email, "ip": ip}
    others = (
        lambda: digits(rng.choice((7, 8, 9, 10, 11, 12, 13, 15, 18))),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        lambda: f"{rng.randint(300, 900)}.{rng.randint(0, 900)}.{rng.randint(256, 900)}.{rng.randint(0, 900)}",
        lambda: f"{digits(2)}.{digits(2)}.{rng.randint(1900, 2030)} {digits(2)}",
        lambda: f"{word()} at {word()} {word()}",
        lambda: f"{word()} at {word()}. {word().capitalize()}",
        lambda: " ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(3, 8))),
        lambda: digits(15) + next(d for d in "0123456789" if d != "0"),
    )
    out = []
    for _ in range(count):
        text, spans = word() + " ", []
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.35:
                text += rng.choice(others)() + rng.choice((" ", f" {word()} "))
                continue
            kind = rng.choice(KINDS)
            part = makers[kind]()
            spans.append((kind, len(text), len(text) + len(part)))
            # beside each other only kinds whose border can be told
            text += part + (" " if kind in ("phone", "card", "ip") else f" {word()} ")
        out.append((text + word(), spans))
    return out


def trained(texts: list[str]) -> Field:
    """A field from generated texts and from the base spans of `texts`."""
    field, examples = Field(), []
    for text, spans in generated(GENERATED):
        examples += labelled(text, spans)
    for text in texts:
        examples += labelled(text, base_spans(text), hidden=True)
    rng = random.Random(11)
    for epoch in range(EPOCHS):
        rng.shuffle(examples)
        for n, found, gold in examples:
            field.learn(n, found, gold, 0.3 / (1 + epoch))
    field.weight = {k: v for k, v in field.weight.items() if abs(v) > 1e-3}
    return field


def labelled(text: str, spans: list[Span], hidden: bool = False) -> list[tuple[int, list[Candidate], set[int]]]:
    """Runs of a text with the candidates that are right.

    With `hidden`, spans may be missing: a run whose labels don't cover each candidate that would be a
    base match by itself teaches nothing.
    """
    out = []
    for a, b in runs(text):
        tokens, found = candidates(text, a, b)
        if not found or len(tokens) > 200:
            continue
        inside = {s for s in spans if a <= s[1] and s[2] <= b}
        gold, covered = set(), set()
        for c, (i, j, kind, _) in enumerate(found):
            span = kind, tokens[i][0], tokens[j - 1][1]
            if span in inside and not covered & set(range(i, j)):
                gold.add(c)
                covered |= set(range(i, j))
        if len(gold) < len(inside):
            continue
        if hidden and any(
            base_spans(text[tokens[i][0] : tokens[j - 1][1]]) and not covered & set(range(i, j))
            for i, j, _, _ in found
        ):
            continue
        out.append((len(tokens), found, gold))
    return out


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ground without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def neighbours(base: list[Span], found: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Each run with the base spans that it overlaps, as disjoint stretches in order."""
    taken = merged([(a, b) for _, a, b in base])
    ends = [b for _, b in taken]
    for a, b in found:
        k = first = bisect_right(ends, a)
        while k < len(taken) and taken[k][0] < b:
            k += 1
        yield a, b, taken[first:k]


def free(tokens: list[tuple[int, int]], found: list[Candidate], taken: list[tuple[int, int]]) -> list[Candidate]:
    """Candidates that touch none of the stretches."""
    ends = [b for _, b in taken]
    out = []
    for c in found:
        k = bisect_right(ends, tokens[c[0]][0])
        if k == len(taken) or taken[k][0] >= tokens[c[1] - 1][1]:
            out.append(c)
    return out


def all_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Base spans and those that the field adds, by start, then kind."""
    near = neighbours(base, list(runs(text)))
    added: list[Span] = []
    placed: list[tuple[int, int]] = []
    for a, b, taken in near:
        tokens, found = candidates(text, a, b)
        if taken:
            found = free(tokens, found, taken)
        if not found:
            continue
        for i, j, kind, _ in field.best(len(tokens), found):
            span = kind, tokens[i][0], tokens[j - 1][1]
            # runs of numbers and of words may overlap: what came first stays
            at = bisect_left(placed, span[1:])
            if (not at or placed[at - 1][1] <= span[1]) and (at == len(placed) or span[2] <= placed[at][0]):
                placed.insert(at, span[1:])
                added.append(span)
    return ordered(base + added)


def fit(docs: DataFrame) -> Field:
    """At most `SAMPLE_ROWS` different texts of middling length that hold digits, by their hash.

    The hashes are chosen first, so that tasks send numbers to the driver, not texts.
    """
    usable = (
        docs.select("text", F.xxhash64("text").alias("h"))
        .filter(F.col("text").rlike("[0-9]{3}") & (F.length("text") <= 4000))
    )
    chosen = usable.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if chosen is None:
        return trained([])
    sample = usable.filter(F.col("h") <= chosen).groupBy("h").agg(F.min("text").alias("text"))
    return trained([r["text"] for r in sample.orderBy("h").collect()])


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def found_spans(docs: DataFrame, field: Field, redact: bool = False) -> DataFrame:
    """`docs` with `pii_base` and `pii_spans`; with `redact` instead with its text and its length
    as they are after redaction."""
    if not redact:
        docs = docs.drop("pii_base", "pii_spans")
    names = docs.columns
    out = docs.limit(0) if redact else docs.limit(0).withColumns({"pii_base": F.lit(""), "pii_spans": F.lit("")})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield looked_at(part)

    def looked_at(part: pa.RecordBatch) -> pa.RecordBatch:
        base_all, span_all, text_all = [], [], []
        for text in texts_of(part, "text").to_pylist():
            base = base_spans(text or "")
            spans = all_spans(text or "", base, field)
            if redact:
                text_all.append(redacted(text, spans) if text else text)
            else:
                base_all.append(written(base))
                span_all.append(written(spans))
        columns = {n: part.column(n) for n in names}
        if not redact:
            return pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(base_all, pa.string()), pa.array(span_all, pa.string())],
                [*names, "pii_base", "pii_spans"],
            )
        columns["text"] = pa.array(text_all, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in text_all], pa.int64())
        return pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(find, out.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found_spans(docs, fit(docs)).drop("text")

    def of(kind: str) -> F.Column:
        listed = F.concat(F.lit(","), "pii_base")
        return F.regexp_count(listed, F.lit(f",{kind}:")).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of(kind) for kind in KINDS],
        F.sha2(F.col("pii_base"), 256).alias("base_sha256"),
        F.col("pii_spans").alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return found_spans(docs, fit(docs), redact=True)
