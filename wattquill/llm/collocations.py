"""Phrases of 2 to 5 words that stand together more often than their parts, by counting quotient filters.

Texts are cut into blocks of one language; a block holds its words as places in a list of its own. The
lists are counted first, a section of the words' hashes at a time: words seen fewer than `LEAST` times can't be in a phrase that is, so only the
others get ids, and the rest only break the stream of words.

Then phrases of 2, 3, 4 and 5 words are counted, a length at a time. A block packs each run of word
ids into machine words and permutes the packed value, which can be undone: nothing is hashed away. The
first bits of the permuted value say which section it belongs to, the next ones are its quotient, all
others its full remainder. A filter keeps the sorted values of one section: quotients as a bit for each
value and each place, remainders in as many bytes as they need, counters in one byte (large ones aside).
The filters of a section are merged over all blocks, whatever block they are from. The merged filter
gives the phrases with `LEAST` or more, and tells each block which of its values these are; the block
keeps only runs of words in which all shorter phrases are that frequent, since no other run can be.

What a task holds is one block, or one section's filters: sections grow in number with the words. A phrase that is everywhere costs one counter a block. Ids, filters and candidates are
never sent to all tasks or to the driver, which sees one number a length.

Defined cases: a null text is an empty one, a null lang is `und`; pieces without words give nothing;
repeated rows count each; ties go by a, then phrase. Texts of any length are whole. Other columns of
any name are left out. An empty table gives no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattquill.llm.common import mixed, slices, stored, table, texts_of, with_text

LEAST = 100
LONGEST = 5
MOST_RANKS = 2000
BLOCK_BYTES = 8_000_000
SECTION_BYTES = 8_000_000
VALUE_BYTES = 10
WORD_BYTES = 25
BREAKS = "[.,;:!?\n\x0b\x0c\r]"
ROUNDS = 4


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


def section_bits(values: int, value_bytes: int) -> int:
    """Bits of a section's number, for sections of about `SECTION_BYTES`."""
    return max(0, -(-values * value_bytes // SECTION_BYTES) - 1).bit_length()


def ranges(section: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal sections."""
    starts = np.flatnonzero(np.r_[True, section[1:] != section[:-1]]).tolist() if len(section) else []
    return list(zip(starts, [*starts[1:], len(section)]))


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, lang, codes (places in `words` from 1 on, 0 for a break), words in the order of their
    hashes, and their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", block_bytes):
                langs = part.column("lang")
                for lang in pc.unique(langs).to_pylist():
                    texts = texts_of(part.filter(pc.equal(langs, lang)), "text")
                    lowered = pc.ascii_lower(texts)
                    # a line feed is a break itself, so none is left inside a word
                    marked = pc.replace_substring_regex(lowered, BREAKS, " \n ")
                    ended = pc.binary_join_element_wise(marked, "\n", " ")
                    found = pc.list_flatten(pc.split_pattern_regex(ended, "[ \t]+"))
                    found = found.filter(pc.not_equal(found, "")).dictionary_encode()
                    words = found.dictionary.filter(pc.not_equal(found.dictionary, "\n"))
                    order = np.argsort(word_hashes(words), kind="stable")
                    rank = np.empty(len(words), np.int64)
                    rank[order] = np.arange(1, len(words) + 1)
                    place = np.zeros(len(found.dictionary), np.int64)
                    place[pc.not_equal(found.dictionary, "\n").to_numpy(zero_copy_only=False)] = rank
                    codes = place[found.indices.to_numpy(zero_copy_only=False)]
                    counts = np.bincount(codes, minlength=len(words) + 1)[1:]
                    block += 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block], pa.int64()),
                            pa.array([lang], pa.string()),
                            pa.array([codes.astype("<u4").tobytes()], pa.binary()),
                            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.take(pa.array(order))),
                            pa.array([counts], pa.list_(pa.int64())),
                        ],
                        ["block", "lang", "codes", "words", "counts"],
                    )

    return docs.mapInArrow(cut, "block long, lang string, codes binary, words array<string>, counts array<long>")


class Packing:
    """Runs of `length` ids of `bits` bits in `limbs` machine words, permuted so that it can be undone.

    Each round changes a limb by a mix of all others, so that the same round undoes it.
    """

    def __init__(self, length: int, bits: int):
        self.length, self.bits = length, bits
        self.limbs = max(2, -(-length // (64 // bits)))
        self.each = -(-length // self.limbs)
        self.width = self.each * bits
        self.mask = np.uint64(2**self.width - 1)

    def change(self, limbs: list[np.ndarray], step: int, j: int) -> None:
        mix = np.full(len(limbs[j]), 0x9E3779B97F4A7C15 * (step + 1) % 2**64, np.uint64)
        for k, other in enumerate(limbs):
            if k != j:
                mix = mixed(mix ^ other)
        limbs[j] = limbs[j] ^ (mix & self.mask)

    def pack(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        limbs = []
        for j in range(self.limbs):
            limb = np.zeros(len(at), np.uint64)
            for k in range(j * self.each, (j + 1) * self.each):
                limb <<= np.uint64(self.bits)
                if k < self.length:
                    limb |= ids[at + k].astype(np.uint64)
            limbs.append(limb)
        for step in range(ROUNDS):
            for j in range(self.limbs):
                self.change(limbs, step, j)
        return limbs

    def unpack(self, limbs: list[np.ndarray]) -> np.ndarray:
        """The ids, a row for each value."""
        limbs = list(limbs)
        for step in reversed(range(ROUNDS)):
            for j in reversed(range(self.limbs)):
                self.change(limbs, step, j)
        low = np.uint64(2**self.bits - 1)
        columns = [
            (limbs[k // self.each] >> np.uint64(self.bits * (self.each - 1 - k % self.each))) & low
            for k in range(self.length)
        ]
        return np.stack(columns, axis=1).astype(np.int64)

    def order(self, limbs: list[np.ndarray]) -> np.ndarray:
        if self.limbs * self.width <= 64:
            whole = limbs[0]
            for limb in limbs[1:]:
                whole = (whole << np.uint64(self.width)) | limb
            return np.argsort(whole, kind="stable")
        return np.lexsort(limbs[::-1])

    def distinct(self, limbs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Sorted values, each once; the order of the given ones, and where each value begins in it."""
        order = self.order(limbs)
        limbs = [limb[order] for limb in limbs]
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([limb[1:] != limb[:-1] for limb in limbs])
        first = np.flatnonzero(fresh)
        return [limb[first] for limb in limbs], order, first

    def section(self, limbs: list[np.ndarray], bits: int) -> np.ndarray:
        return (limbs[0] >> np.uint64(self.width - bits)).astype(np.int64) if bits else np.zeros(len(limbs[0]), np.int64)

    def filter(self, limbs: list[np.ndarray], counts: np.ndarray, bits: int) -> bytes:
        """The filter of sorted values of one section of `bits` bits."""
        n = len(counts)
        rest = self.width - bits
        quotient_bits = min(rest, max(0, n.bit_length() - 1))
        remainder_bits = rest - quotient_bits
        low = limbs[0] & np.uint64(2**rest - 1)
        quotient = (low >> np.uint64(remainder_bits)).astype(np.int64) if remainder_bits < 64 else np.zeros(n, np.int64)
        runs = np.zeros(n + 2**quotient_bits, np.uint8)
        runs[np.arange(n) + quotient] = 1
        small = np.minimum(counts, 255).astype(np.uint8)
        parts = [np.array([n], "<u4").tobytes(), bytes([quotient_bits]), np.packbits(runs).tobytes()]
        parts.append(in_bytes(low & np.uint64(2**remainder_bits - 1), remainder_bits))
        parts += [in_bytes(limb, self.width) for limb in limbs[1:]]
        parts += [small.tobytes(), counts[small == 255].astype("<u8").tobytes()]
        return b"".join(parts)

    def values(self, raw: bytes, section: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Values and counters of a filter."""
        n = int.from_bytes(raw[:4], "little")
        quotient_bits = raw[4]
        rest = self.width - bits
        remainder_bits = rest - quotient_bits
        at = 5
        size = -(-(n + 2**quotient_bits) // 8)
        runs = np.unpackbits(np.frombuffer(raw, np.uint8, size, at))
        quotient = (np.flatnonzero(runs)[:n] - np.arange(n)).astype(np.uint64)
        at += size
        limbs = []
        for width in [remainder_bits] + [self.width] * (self.limbs - 1):
            size = -(-width // 8)
            limbs.append(from_bytes(raw, at, n, size))
            at += n * size
        high = np.uint64((section << rest) % 2**64)
        limbs[0] |= high
        if remainder_bits < 64:
            limbs[0] |= quotient << np.uint64(remainder_bits)
        counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw, "<u8", offset=at + n).astype(np.int64)
        return limbs, counts


def in_bytes(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def from_bytes(raw: bytes, at: int, n: int, size: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return wide.view("<u8").ravel().astype(np.uint64)


def runs_of(ids: np.ndarray, length: int) -> np.ndarray:
    """Where runs of `length` ids without a break begin."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    breaks = np.cumsum(np.r_[0, ids == 0])
    return np.flatnonzero(breaks[length : length + n] == breaks[:n])


def without_gaps(ids: np.ndarray, keep: np.ndarray, length: int) -> np.ndarray:
    """The stream that has just the runs of `length` ids all of whose inner runs, one id shorter, begin
    at a place in `keep` (ascending)."""
    linked = keep[:-1][np.diff(keep) == 1]
    if not len(linked):
        return np.zeros(0, ids.dtype)
    first = np.r_[True, np.diff(linked) > 1]
    starts = linked[first]
    ends = np.r_[linked[:-1][first[1:]], linked[-1]] + length + 1
    size = ends - starts + 1
    edges = np.cumsum(size)
    at = np.arange(int(edges[-1])) + np.repeat(starts - (edges - size), size)
    out = ids[np.minimum(at, len(ids) - 1)].copy()
    out[edges - 1] = 0
    return out


def stream_row(block: int, lang: str, ids: np.ndarray, length: int) -> pa.Table:
    return pa.Table.from_pydict(
        {"block": [block], "lang": [lang], "ids": [ids.astype("<u4").tobytes()], "runs": [len(runs_of(ids, length))]},
        schema=pa.schema([("block", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("runs", pa.int64())]),
    )


STREAM = "block long, lang string, ids binary, runs long"


def numbered(cut: DataFrame, least: int) -> DataFrame:
    """lang, word, n, id (from 1 on) of the words seen `least` times or more, and for each block and
    section the ids of its words, 0 for the others.

    Sections are ranges of the words' hashes; lists of a section are merged over all blocks.
    """
    bits = section_bits(cut.agg(F.sum(F.size("words"))).first()[0] or 0, WORD_BYTES)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, block, words, counts = (batch.column(c).slice(row, 1) for c in ("lang", "block", "words", "counts"))
                words, counts = words.flatten(), counts.flatten()
                section = (word_hashes(words) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
                for s, e in ranges(section):
                    yield pa.RecordBatch.from_arrays(
                        [
                            lang,
                            pa.array([section[s]], pa.int64()),
                            block,
                            *(pa.ListArray.from_arrays(pa.array([0, e - s], pa.int32()), x.slice(s, e - s)) for x in (words, counts)),
                        ],
                        ["lang", "section", "block", "words", "counts"],
                    )

    def number(group: pa.Table) -> pa.Table:
        lists = group.column("words").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        found = lists.flatten().dictionary_encode()
        index = found.indices.to_numpy(zero_copy_only=False)
        counts = group.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        total = np.zeros(len(found.dictionary), np.int64)
        np.add.at(total, index, counts)
        often = total >= least
        # ids of all sections interleave, so they stay dense
        ids = np.where(often, (np.cumsum(often) - 1 << bits) + group.column("section")[0].as_py() + 1, 0)
        ends = np.cumsum(sizes)
        own = [ids[index[e - n : e]].astype("<u4").tobytes() for n, e in zip(sizes, ends)]
        n, m = int(often.sum()), group.num_rows
        words = found.dictionary.filter(pa.array(often))
        known = [pa.array([group.column("lang")[0].as_py()] * n, pa.string()), words, pa.array(total[often]), pa.array(ids[often])]
        empty = [pa.nulls(m, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
        back = [group.column("block"), group.column("section"), pa.array(own, pa.binary())]
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        names = ["lang", "word", "n", "id", "block", "section", "ids"]
        return pa.concat_tables([pa.Table.from_arrays(x, names) for x in ([*known, *none], [*empty, *back])])

    return (
        cut.select("lang", "block", "words", "counts")
        .mapInArrow(split, "lang string, section long, block long, words array<string>, counts array<long>")
        .groupBy("lang", "section")
        .applyInArrow(number, "lang string, word string, n long, id long, block long, section long, ids binary")
    )


def streams(cut: DataFrame, ids: DataFrame) -> DataFrame:
    """Each block as ids of frequent words; all else is a break."""

    def translate(block: pa.Table, known: pa.Table) -> pa.Table:
        if not block.num_rows or not known.num_rows:
            return stream_row(0, "", np.zeros(0), 2).slice(1)
        (raw,) = block.column("codes").to_pylist()
        # sections follow one another as the words of a block do
        of_code = np.frombuffer(bytes(4) + b"".join(known.sort_by("section").column("ids").to_pylist()), "<u4")
        out = of_code[np.frombuffer(raw, "<u4")]
        out = out[(out != 0) | (np.r_[0, out[:-1]] != 0)]
        return stream_row(block.column("block")[0].as_py(), block.column("lang")[0].as_py(), out, 2)

    known = ids.filter("ids is not null").select(F.col("block").alias("of"), "section", "ids")
    return (
        cut.select("block", "lang", "codes").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(translate, STREAM)
    )


def filters(stream: DataFrame, packing: Packing, bits: int) -> DataFrame:
    """lang, section, block and filter of the runs of each block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, block, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u4")
                limbs = packing.pack(ids, runs_of(ids, packing.length))
                limbs, order, first = packing.distinct(limbs)
                counts = np.diff(np.r_[first, len(order)])
                section = packing.section(limbs, bits)
                for s, e in ranges(section):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang], pa.string()),
                            pa.array([section[s]], pa.int64()),
                            pa.array([block], pa.int64()),
                            pa.array([packing.filter([x[s:e] for x in limbs], counts[s:e], bits)], pa.binary()),
                        ],
                        ["lang", "section", "block", "filter"],
                    )

    return (
        stream.filter("runs > 0")
        .select("lang", "block", "ids")
        .mapInArrow(build, "lang string, section long, block long, filter binary")
    )


MERGED = pa.schema(
    [
        ("lang", pa.string()),
        ("words", pa.list_(pa.int64())),
        ("a", pa.int64()),
        ("block", pa.int64()),
        ("section", pa.int64()),
        ("mask", pa.binary()),
        ("held", pa.int64()),
    ]
)


def merged(parts: DataFrame, packing: Packing, bits: int, least: int) -> DataFrame:
    """Frequent runs (lang, words, a), and for each block (block, section) which of its values they are."""

    def merge(group: pa.Table) -> pa.Table:
        lang, section = (group.column(c)[0].as_py() for c in ("lang", "section"))
        owners = group.column("block").to_pylist()
        found = [packing.values(raw, section, bits) for raw in group.column("filter").to_pylist()]
        sizes = [len(counts) for _, counts in found]
        limbs = [np.concatenate([f[0][j] for f in found]) for j in range(packing.limbs)]
        counts = np.concatenate([c for _, c in found])
        limbs, order, first = packing.distinct(limbs)
        total = np.add.reduceat(counts[order], first)
        often = total >= least
        flags = np.zeros(len(order), bool)
        flags[order] = np.repeat(often, np.diff(np.r_[first, len(order)]))
        ends = np.cumsum(sizes)
        masks = [np.packbits(flags[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
        words = packing.unpack([limb[often] for limb in limbs])
        n, m = len(words), len(masks)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * packing.length, pa.int32()), pa.array(words.ravel(), pa.int64())
        )
        grams = [pa.array([lang] * n, pa.string()), lists, pa.array(total[often]), *(pa.nulls(n, f.type) for f in list(MERGED)[3:])]
        back = [
            *(pa.nulls(m, f.type) for f in list(MERGED)[:3]),
            pa.array(owners, pa.int64()),
            pa.array([section] * m, pa.int64()),
            pa.array(masks, pa.binary()),
            pa.array(sizes, pa.int64()),
        ]
        return pa.concat_tables([pa.Table.from_arrays(x, schema=MERGED) for x in (grams, back)])

    return parts.groupBy("lang", "section").applyInArrow(
        merge, "lang string, words array<long>, a long, block long, section long, mask binary, held long"
    )


def narrowed(stream: DataFrame, masks: DataFrame, packing: Packing) -> DataFrame:
    """Each block with the runs left whose parts are all frequent."""

    def narrow(block: pa.Table, masks: pa.Table) -> pa.Table:
        if not block.num_rows or not masks.num_rows:
            return stream_row(0, "", np.zeros(0), 2).slice(1)
        number, lang, raw = (block.column(c)[0].as_py() for c in ("block", "lang", "ids"))
        ids = np.frombuffer(raw, "<u4")
        starts = runs_of(ids, packing.length)
        limbs, order, first = packing.distinct(packing.pack(ids, starts))
        by_section = masks.sort_by("section")
        # sections are ranges of the sorted values: the masks follow one another as the values do
        size = by_section.column("held").to_pylist()
        often = np.concatenate(
            [
                np.unpackbits(np.frombuffer(m, np.uint8), count=n)
                for m, n in zip(by_section.column("mask").to_pylist(), size, strict=True)
            ]
        ).astype(bool)
        flags = np.zeros(len(order), bool)
        flags[order] = np.repeat(often, np.diff(np.r_[first, len(order)]))
        out = without_gaps(ids, starts[flags], packing.length)
        return stream_row(number, lang, out, packing.length + 1)

    masks = masks.filter("mask is not null").select(F.col("block").alias("of"), "section", "mask", "held")
    return stream.groupBy("block").cogroup(masks.groupBy("of")).applyInArrow(narrow, STREAM)


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES):
    """lang, words (ids) and a of all phrases of up to `longest` words seen `least` times or more;
    the dictionary of the ids; and lang, n: the number of all words."""
    docs = with_text(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"))
    cut = stored(blocks(docs, block_bytes), "blocks")
    totals = cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c).alias("n"))
    totals = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stored(numbered(cut, least), "words")
    ids = words.filter("word is not null").select("lang", "word", "n", "id")
    most = ids.agg(F.max("id")).first()[0] or 1
    stream = stored(streams(cut, words), "stream")
    grams = ids.select("lang", F.array("id").alias("words"), F.col("n").alias("a"))
    for length in range(2, longest + 1):
        packing = Packing(length, int(most).bit_length())
        bits = min(packing.width, section_bits(stream.agg(F.sum("runs")).first()[0] or 0, VALUE_BYTES))
        found = stored(merged(filters(stream, packing, bits), packing, bits, least), "grams")
        grams = grams.unionByName(found.filter("words is not null").select("lang", "words", "a"))
        if length < longest:
            stream = stored(narrowed(stream, found, packing), "stream")
    return grams, ids, totals


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST_RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `most` phrases of each language."""
    grams, ids, totals = counted(docs, least, longest, block_bytes)
    long_ones = grams.filter("size(words) > 1")
    # f never rises with length: a longer phrase as frequent covers all between, so the next length tells
    inner = F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)")))
    covered = long_ones.filter("size(words) > 2").select("lang", inner.alias("words"), "a").distinct()
    left = long_ones.join(covered, ["lang", "words", "a"], "left_anti")
    cuts = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("slice(words, 1, k)")).withColumn("rest", F.expr("slice(words, k + 1, size(words) - k)"))
    wide = "decimal(38,0)"
    scored = (
        cuts.join(grams.select("lang", F.col("words").alias("first"), F.col("a").alias("l")), ["lang", "first"])
        .join(grams.select("lang", F.col("words").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        .withColumn("score", F.expr(f"(cast(1000 as {wide}) * a * n) div (cast(l as {wide}) * r)"))
        .groupBy("lang", "words", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
        .select("lang", "words", "a", "n", "best.l", "best.r", "best.score")
    )
    spelled = (
        scored.select("*", F.posexplode("words").alias("place", "id"))
        .join(ids.select("lang", "id", "word"), ["lang", "id"])
        .groupBy("lang", "words", "a", "n", "l", "r", "score")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "word")))["word"], " ").alias("phrase"))
    )
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with texts as (
    select coalesce(lang, 'und') as lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
),
pieces as (
    select lang, regexp_extract_all(piece, '[^ 	]+') as words
    from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) as piece from texts)
),
runs as (
    select lang, size, unnest(list_transform(range(1, len(words) - size + 2),
                                             lambda i: array_to_string(words[i:i + size - 1], ' '))) as phrase
    from pieces, (select unnest(range(1, 6)) as size)
    where len(words) >= size
),
counts as (select lang, size, phrase, count(*) as a from runs group by all having count(*) >= 100),
totals as (select lang, sum(len(words)) as n from pieces group by lang),
covered as (
    select distinct short.lang, short.phrase
    from counts short join counts other
      on other.lang = short.lang and other.size > short.size and 100 * other.a >= 100 * short.a
         and contains(' ' || other.phrase || ' ', ' ' || short.phrase || ' ')
    where short.size > 1
),
cuts as (
    select lang, size, phrase, a, k, string_split(phrase, ' ') as words
    from (select *, unnest(range(1, size)) as k from counts where size > 1)
    where (lang, phrase) not in (select (lang, phrase) from covered)
),
scored as (
    select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, t.n,
           (1000::hugeint * c.a * t.n) // (l.a::hugeint * r.a) as score
    from cuts c
    join counts l on l.lang = c.lang and l.phrase = array_to_string(c.words[1:c.k], ' ')
    join counts r on r.lang = c.lang and r.phrase = array_to_string(c.words[c.k + 1:], ' ')
    join totals t on t.lang = c.lang
),
lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, rank, phrase, a, l, r, n, score from (
    select lang, cast(row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as bigint) as rank,
           phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
           cast(n as bigint) as n, cast(score as bigint) as score
    from lowest
) where rank <= 2000
"""
