from pyspark.sql import functions as F

from wattquill.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def test_levels():
    text = "top\nOn Monday Bob wrote:\n> one\n>> two\n> > two b\n> three\nend"
    assert quotes.levels(text) == [(0, "top"), (1, "one"), (2, "two\ntwo b"), (1, "three"), (0, "end")]
    assert quotes.levels("a > b") == [(0, "a > b")]
    assert quotes.levels("") == [(0, "")]


def test_rewrapped_quotes_hash_alike():
    assert quotes.sentence_hashes("Tea is GOOD,\nreally. Yes") == quotes.sentence_hashes("tea is  good really! ok")


def plain(rows):
    """Replies and order by going through each conversation."""
    parents = {}
    for c, t, _, text in rows:
        votes = {}
        for depth, p in quotes.levels(text or ""):
            for u in quotes.sentence_hashes(p) if depth else ():
                holders = [
                    t2 for c2, t2, _, x in rows
                    if c2 == c is not None and t2 is not None
                    and any(u in quotes.sentence_hashes(q) for d, q in quotes.levels(x or "") if not d)
                ]
                if holders and t is not None and min(holders) < t:
                    votes.setdefault((depth, min(holders)), set()).add(u)
        if votes:
            parents[c, t] = max((-d, len(us), o) for (d, o), us in votes.items())[2]

    def root(c, t):
        depth = 0
        while (c, t) in parents:
            t, depth = parents[c, t], depth + 1
        return t, depth

    return sorted((str(c), str(t), parents.get((c, t)), *root(c, t)[1:], str(root(c, t)[0])) for c, t, _, _ in rows)


ROWS = [
    (1, 0, "user", "I like tea very much. Do you like it too?"),
    (1, 1, "assistant", "Coffee is better than tea.\nBut water is best."),
    (1, 2, "user", "On Monday Bob wrote:\n> Coffee is better\n> than tea.\n\nNo way it is."),
    (1, 3, "user", "> > I like tea very much.\n> Coffee is better than tea.\nI agree with this one."),
    (1, 4, "user", "> No way it is.\nYes way it is. I like tea very much."),
    (1, 4, "user", "> No way it is.\nYes way it is. I like tea very much."),
    (1, 5, "user", None),
    (1, 6, "user", "> never said by anyone\nbare"),
    (1, 7, "user", ">> I like tea very much.\nlate answer here"),
    (2, 0, None, "> Coffee is better than tea."),
    (None, 0, "user", "> I like tea very much."),
    (3, None, "user", "no turn given"),
]


def test_replies(frame):
    got = quotes.ordered(frame(ROWS, SCHEMA).withColumn("depth", F.lit("x"))).collect()
    assert sorted((str(r.conv_id), str(r.turn), r.reply_to, r.depth, str(r.thread)) for r in got) == plain(ROWS)
    for c in (1, 2, 3, None):
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        seen = set()
        for r in own:
            assert r.reply_to is None or r.reply_to in seen
            seen.add(r.turn)
    assert not any(">" in r.own for r in got)


def test_short_quotes_and_scripts_without_spaces(frame):
    rows = [
        (1, 0, "u", "Shall we go there?"), (1, 1, "v", "Yes."), (1, 2, "u", "> Yes.\nWhen is it then?"), (1, 3, "v", ">> Yes.\n> When is it then?\nSoon."),
        (1, 4, "u", "Thanks!"), (1, 5, "v", "> thanks\nWelcome"), (1, 6, "u", "👍"), (1, 7, "v", "> 👍\nok"),
        (2, 0, "u", "我喜欢喝茶。你也喜欢喝茶吗？"), (2, 1, "v", "咖啡更好。水是最好的。"), (2, 2, "u", "> 水是\n> 最好的。\n不对。"), (2, 3, "v", "> 我喜欢喝茶。\n好。"), (2, 4, "u", "> 好。\n对"),
        # a long sentence decides, a short one between equals
        (3, 0, "u", "Red. The first remark here."), (3, 1, "v", "Blue. The second remark here."), (3, 2, "u", "> Red.\n> The second remark here."),
        (3, 3, "v", "> Red. The first remark here.\n> The second remark here."),
    ]
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.ordered(frame(rows, SCHEMA)).collect() if r.reply_to is not None}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 5): 4, (1, 7): 6, (2, 2): 1, (2, 3): 0, (2, 4): 3, (3, 2): 1, (3, 3): 0}


def test_deep_threads(frame):
    rows = [(1, 0, "u", "begin with number zero.")]
    rows += [(1, k, "u", f"> {rows[0][3] if k == 1 else f'answer with number {k - 1}x.'}\nanswer with number {k}x.") for k in range(1, 70)]
    rows += [(1, 100 + k, "v", f"separate remark number {k}y.") for k in range(5)]
    got = {r.turn: r for r in quotes.ordered(frame(rows, SCHEMA)).collect()}
    assert [got[k].depth for k in range(70)] == list(range(70))
    assert {got[k].thread for k in range(70)} == {0} and got[102].thread == 102


def test_one_long_thread(spark):
    """A thread of 100,000 messages is numbered in buckets of 64 turns; all of it is in order."""
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
        F.when(F.col("id") == 0, "begin with this one.").otherwise(F.concat(F.lit("> begin with this one.\nanswer "), F.col("id").cast("string"))).alias("text"),
    )
    got = quotes.ordered(rows)
    assert got.filter("position = turn + 1 AND thread = 0 AND coalesce(reply_to, 0) = 0").count() == n
    placed = quotes.with_places(got)
    assert placed.groupBy("conv_id", *quotes.PLACES).count().agg(F.max("count")).first()[0] == 64


def test_hashes_are_those_of_units_and_whole():
    for text in ("", "Yes.", "Tea is good. Is it? 好。我喜欢喝茶。 …", "👍", "!? . ...", "one_two a.b c\n\n d. e"):
        units = {quotes.normalised(x) for x in (*quotes.SENTENCE.split(text), text)} - {""}
        long, short = quotes.hashes(text)
        assert long == {quotes.hashed(u) for u in map(quotes.normalised, quotes.SENTENCE.split(text)) if quotes.is_long(u)}
        assert long | short == {quotes.hashed(u) for u in units}


def test_parts(frame):
    got = quotes.conversations(frame(ROWS, SCHEMA), 4).collect()
    assert sum(r.n_messages for r in got) == len(ROWS)
    first = next(r for r in got if r.conv_id == 1 and r.part == 0)
    assert first.text.startswith("<|user|>\nI like tea very much.") and "<|user re 1|>\nNo way it is." in first.text
    assert quotes.conversations(frame([], SCHEMA)).count() == 0


def test_plain_conversations_keep_their_order(spark, small):
    got = quotes.ordered(spark.read.parquet(f"{small}/conversations.parquet")).collect()
    for r in got:
        assert r.reply_to is None and r.depth == 0
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.position)):
        by.setdefault(r.conv_id, []).append(r.turn)
    assert all(t == sorted(t) for t in by.values())
