"""Conversations without quotes, in the order of replies, from messages that quote each other.

A line that begins with one or more `>` is quoted, as deep as it has marks; lines next to each other
with one depth are a passage, whatever its line breaks. A line that ends in a colon right before a
quote and names who wrote (`On ... wrote:`) goes with it. Passages and own text are cut into
sentences; normalised (letters and digits only, lower case) they are hashed. A quoted sentence is
joined to the first message of its conversation that has it as its own text; the message that most
of the shallowest quotes point to, the later of two, is the one replied to. Sentences of one word, and
passages as a whole, decide between equals, and alone where no longer sentence links. Replies hang together as
threads; within a conversation threads follow each other by their first message, and a reply always
comes after what it answers. Messages without a link begin a thread, so plain conversations keep
their order. The messages, freed from quotes, are written in parts of at most `PART` messages.

Both sides are counted up before they are joined, on conversation and hash, with one row per key on
the original's side; positions are counted in buckets, of threads and of turns within one. Nothing gathers a whole
conversation or thread.

Defined cases: a null text is an empty one; a message that holds quotes only stays, empty. Null
conversations have no links, null turns come first and have none. Rows that repeat a turn stay and
share its links. A null role is written as `unknown`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.functions.ranking import bucketed_row_number
from wattquill.llm.common import slices, stored, table, with_text

PART = 64
LEAST_WORDS = 2
MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
WROTE = re.compile(r"\b(wrote|writes|said|schrieb|escribió|écrit)\b.*:\s*$", re.I)
SENTENCE = re.compile(r"[.!?…]+(?:\s+|$)|[。！？｡．]+\s*|\n{2,}")
INNER = re.compile(r"[^\w]+|_+")
# letters of scripts without spaces between words: so many count as a sentence
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]"
UNSPACED_LETTER = re.compile(UNSPACED)
UNSPACED_BREAK = re.compile(f"(?<={UNSPACED}) (?={UNSPACED})")
LEAST_UNSPACED = 4
MOST_ROUNDS = 64


def levels(text: str) -> list[tuple[int, str]]:
    """Passages of a message with their quote depth, in order; 0 is own text."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = MARKS.match(line)
        depth = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if not out or out[-1][0] != depth:
            out.append((depth, []))
        out[-1][1].append(body)
    found = []
    for k, (depth, lines) in enumerate(out):
        if k + 1 < len(out) and out[k + 1][0] > depth:
            while lines and not lines[-1].strip():
                lines.pop()
            if lines and WROTE.search(lines[-1]):
                lines.pop()
        found.append((depth, "\n".join(lines)))
    return found


def letters(text: str) -> str:
    """Letters and digits, lower case."""
    return UNSPACED_BREAK.sub("", " ".join(INNER.sub(" ", text.lower()).split()))


def normalised(text: str) -> str:
    """Letters and digits, lower case; of a text without any, its marks."""
    return letters(text) or "".join(text.split())


def hashed(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit) - 2**63


def is_long(unit: str) -> bool:
    return unit.count(" ") + 1 >= LEAST_WORDS or len(UNSPACED_LETTER.findall(unit)) >= LEAST_UNSPACED


def hashes(passage: str) -> tuple[set[int], set[int]]:
    """Hashes of the sentences with at least `LEAST_WORDS` words, or as much without spaces, and those
    of the shorter ones and of the whole passage."""
    parts = SENTENCE.split(passage)
    worded = [letters(x) for x in parts]
    units = {w or "".join(x.split()) for w, x in zip(worded, parts, strict=True)}
    long = {u for u in units if is_long(u)}
    # sentences end between words, so that those of the passage are theirs
    whole = UNSPACED_BREAK.sub("", " ".join(filter(None, worded))) or "".join(passage.split())
    return set(map(hashed, long)), {hashed(u) for u in (units | {whole}) - long if u}


def sentence_hashes(passage: str) -> set[int]:
    return hashes(passage)[0]


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes), units (hashes of own sentences and passages) and
    quoted (depth, hash, and whether it is of a long sentence)."""
    schema = "conv_id long, turn long, role string, own string, units array<long>, quoted array<struct<depth:int,unit:long,long:boolean>>"
    quoted_type = pa.list_(pa.struct([("depth", pa.int32()), ("unit", pa.int64()), ("long", pa.bool_())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, units, quoted = [], [], []
                for text in part.column("text").to_pylist():
                    passages = levels(text.replace("\r\n", "\n"))
                    mine = "\n".join(p for depth, p in passages if not depth)
                    own.append(re.sub(r"\n{3,}", "\n\n", mine).strip())
                    found = [(d, *hashes(p)) for d, p in passages]
                    units.append(sorted(set().union(*(long | short for d, long, short in found if not d))))
                    quoted.append(
                        [
                            {"depth": d, "unit": u, "long": is_}
                            for d, long, short in found
                            if d
                            for is_, some in ((True, long), (False, short))
                            for u in sorted(some)
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array(own, pa.string()), pa.array(units, pa.list_(pa.int64())), pa.array(quoted, quoted_type)],
                    ["conv_id", "turn", "role", "own", "units", "quoted"],
                )

    return with_text(messages).select("conv_id", "turn", "role", "text").mapInArrow(parse, schema)


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn and the turn replied to, of messages whose quotes are found."""
    known = rows.filter("conv_id is not null and turn is not null")
    asked = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select(
        "conv_id", "turn", "q.depth", "q.unit", "q.long"
    ).distinct()
    first = (
        known.select("conv_id", "turn", F.explode("units").alias("unit"))
        .join(asked.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi")
        .groupBy("conv_id", "unit")
        .agg(F.min("turn").alias("reply_to"))
    )
    # read from a table of its own, a sentence that very many messages quote can be split in the join
    first = stored(first, "originals")
    return (
        asked.join(first, ["conv_id", "unit"])
        .filter("reply_to < turn")
        .groupBy("conv_id", "turn", "depth", "reply_to")
        .agg(F.count_if("long").alias("n"), F.count_if(~F.col("long")).alias("short"))
        .groupBy("conv_id", "turn")
        .agg(F.max_by("reply_to", F.struct(F.col("n") > 0, -F.col("depth"), "n", "short", "reply_to")).alias("reply_to"))
    )


def threads(found: DataFrame) -> DataFrame:
    """`links` with the first message of the thread and the number of replies down to this one.

    Pointers are doubled: as many rounds as the logarithm of the deepest thread.
    """
    state = stored(found.withColumns({"thread": F.col("reply_to"), "depth": F.lit(1).cast("bigint")}), "threads")
    for _ in range(MOST_ROUNDS):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"), F.col("depth").alias("_more"))
        step = state.join(up, ["conv_id", "thread"], "left")
        if step.filter("_up is not null").isEmpty():
            return state
        state = stored(
            step.select("conv_id", "turn", "reply_to", F.coalesce("_up", "thread").alias("thread"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")),
            "threads",
        )
    raise RuntimeError("threads did not settle")


PLACES = ["_wide", "_near", "_far_turn", "_near_turn"]


def with_places(placed: DataFrame) -> DataFrame:
    """Buckets along (thread, turn): the finest holds at most 64 turns of one thread."""
    return placed.withColumns(
        {
            "_wide": F.floor(F.col("thread") / 4096),
            "_near": F.col("thread"),
            "_far_turn": F.floor(F.col("turn") / 4096),
            "_near_turn": F.floor(F.col("turn") / 64),
        }
    )


def ordered(messages: DataFrame) -> DataFrame:
    """conv_id, position (from 1), turn, role, own, reply_to, depth and thread of each message."""
    rows = stored(parsed(messages), "messages")
    linked = threads(links(rows))
    placed = (
        rows.select("conv_id", "turn", "role", "own")
        .join(linked, ["conv_id", "turn"], "left")
        .withColumns({"thread": F.coalesce("thread", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("bigint"))})
    )
    return bucketed_row_number(
        with_places(placed), ["conv_id"], PLACES, ["thread", "turn", "role", "own"], "position"
    ).drop(*PLACES)


def conversations(messages: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part (from 0), n_messages, n_linked, turns and text: the formatted messages in order."""
    rows = ordered(messages)
    head = F.concat(
        F.lit("<|"),
        F.coalesce("role", F.lit("unknown")),
        F.when(F.col("reply_to").isNotNull(), F.concat(F.lit(" re "), F.col("reply_to").cast("string"))).otherwise(""),
        F.lit("|>\n"),
        F.col("own"),
    )
    listed = F.array_sort(F.collect_list(F.struct("position", "turn", head.alias("text"))))
    return (
        rows.withColumn("part", F.floor((F.col("position") - 1) / part))
        .groupBy("conv_id", "part")
        .agg(F.count("*").alias("n_messages"), F.count("reply_to").alias("n_linked"), listed.alias("m"))
        .select(
            "conv_id",
            "part",
            "n_messages",
            "n_linked",
            F.concat_ws(",", F.transform("m", lambda x: F.coalesce(x["turn"].cast("string"), F.lit("")))).alias("turns"),
            F.concat_ws("\n", F.transform("m", lambda x: x["text"])).alias("text"),
        )
    )


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
