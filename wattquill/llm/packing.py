"""Packing of tokenised documents into sequences, with Martello-Toth dominance before best fit.

Only the lengths matter for a packing, and there are at most `CAPACITY` of them: the plan is made
from their counts, a table of fixed size, and covers all pieces at once. First item sets that
provably dominate every other way to pack their largest item are fixed, for as many copies as there
are: a piece alone that nothing fits beside; two pieces that fill a sequence exactly; a piece with
the largest one that fits, if no two fit or no two together are larger; a piece with two others, if
every other choice is dominated by them. The rest is packed best fit, longest first, a whole group
of equal lengths at a time. The plan lists, for each length, which ranks go to which sequences; each
piece then finds its place by its rank among the pieces of its length. Ranks are counted bucket by
bucket, so a length that a third of all pieces have is spread over many tasks.

Defined cases: a null text is an empty one, a single end mark (id 0); longer documents are cut into
full pieces and a rest; repeated rows are packed each. The tokenizer's file is a parameter.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattquill.llm.common import once_per_worker, slices, stored, table, texts_of, with_text

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
CACHED = 400_000
WORD_END = "</w>"
# letters without a case mapping or composition of their own kind, and marks that never join them
LATIN_WORD = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
ROWS_PER_BUCKET = 20_000


class Encoder:
    """Ids of texts. Spaces and line feeds always part tokens in this vocabulary, so that each
    distinct stretch between them is encoded once and looked up from then on.

    Most stretches are a Latin word with marks behind it. The vocabulary lowers its case and parts it
    from the marks, so that both are looked up by themselves; words that are new are encoded many at a
    time, and the end mark of a word's last token says where the next begins.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = [np.zeros(0, np.uint32)]
        self.size = [np.zeros(1, np.int64)]

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.flat.append(ids.astype(np.uint32))
        self.size.append(size)

    def learn_whole(self, names: list[str]) -> None:
        for k in range(0, len(names), 10_000):
            some = names[k : k + 10_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.add(some, np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def learn_words(self, names: list[str]) -> None:
        for k in range(0, len(names), 1000):
            some = names[k : k + 1000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self.add(some, ids, np.diff(ends, prepend=0))
            else:
                self.learn_whole(some)

    def places(self, names: pa.Array, learn) -> np.ndarray:
        """Where the ids of each name are; names may repeat or be null (the empty name)."""
        encoded = pc.fill_null(names, "").dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        place = self.place
        if new := [n for n in distinct if n not in place]:
            learn(new)
        where = np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))
        return where[encoded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = pc.list_flatten(parts).dictionary_encode()
        if len(self.place) > CACHED:
            self.clear()
        split = pc.extract_regex(encoded.dictionary, LATIN_WORD)
        plain = pc.is_valid(split)
        word, marks = (pc.if_else(plain, pc.struct_field(split, k), "") for k in (0, 1))
        other = pc.if_else(plain, "", encoded.dictionary)
        entries = np.stack(
            [
                self.places(pc.utf8_lower(word), self.learn_words),
                self.places(marks, self.learn_whole),
                self.places(other, self.learn_whole),
            ],
            axis=1,
        )
        self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        flat, sizes = self.flat[0], self.size[0]
        # the ids of each distinct stretch, then those of all
        each = entries.ravel()
        flat, sizes = gathered(flat, np.cumsum(sizes) - sizes, sizes, each), sizes[each].reshape(-1, 3).sum(axis=1)
        code = encoded.indices.to_numpy(zero_copy_only=False)
        out = gathered(flat, np.cumsum(sizes) - sizes, sizes, code)
        cuts = np.r_[0, np.cumsum(sizes[code])][np.r_[0, np.cumsum(counts)]]
        return out, np.diff(cuts)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches `which` of `flat`, one after the other."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first[which] - (ends - n), n) + np.arange(total)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, sizes = encoder.encode(texts_of(part, "text"))
                ends = np.cumsum(sizes)
                doc, piece, length, crc = [], [], [], []
                for row, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        chunk = own[k : k + capacity]
                        doc.append(row)
                        piece.append(k // capacity)
                        length.append(len(chunk))
                        crc.append(zlib.crc32(chunk.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array([p * capacity for p in piece], pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Places for the pieces of each length, in the order of their ranks."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = dict(sorted((length, n) for length, n in counts.items() if n))
        self.used: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.reduce()
        self.best_fit()

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        """The next `count` pieces of a length go to sequences from `sequence` on, at `offset`."""
        first = self.used.get(length, 0)
        self.rows.append((length, first, count, sequence, offset))
        self.used[length] = first + count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...]) -> None:
        """Sequences with exactly these pieces, as many as the counts allow."""
        count = min(self.left[n] // lengths.count(n) for n in lengths)
        offset = 0
        for n in lengths:
            self.place(n, count, self.sequences, offset)
            offset += n
        self.sequences += count

    def dominating(self, length: int) -> tuple[int, ...] | None:
        """A set with a piece of this length that dominates all other sets with it."""
        room = self.capacity - length
        rest = sorted(n for n in self.left if n <= room)

        def there(*wanted: int) -> bool:
            return all(self.left.get(n, 0) - (n == length) >= wanted.count(n) for n in wanted)

        rest = [n for n in rest if there(n)]
        if not rest:
            return (length,)
        if rest[-1] == room:
            return length, room
        smallest = []
        for n in rest[:3]:
            smallest += [n] * min(3, self.left[n] - (n == length))
        smallest = smallest[:3]
        largest = rest[-1]
        if len(smallest) < 2 or sum(smallest[:2]) > room:
            return length, largest
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        # at most two fit: the largest alone against the best pair
        pair = 0
        for a in rest:
            k = bisect_left(rest, min(a, room - a) + 1) - 1
            while k >= 0 and not there(a, rest[k]):
                k -= 1
            if k >= 0:
                pair = max(pair, a + rest[k])
        if pair <= largest:
            return length, largest
        # any pair has a smaller piece of at most half the room
        k = bisect_left(rest, room // 2 + 1) - 1
        if k >= 0 and largest + rest[k] <= room and there(largest, rest[k]):
            return length, largest, rest[k]
        return None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in sorted(self.left, reverse=True):
                while length in self.left and (found := self.dominating(length)):
                    self.fix(found)
                    changed = True

    def best_fit(self) -> None:
        """Longest first into the fullest open sequences with room."""
        open_: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def leave(room: int, sequence: int, count: int) -> None:
            if room and count:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((sequence, count))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    sequence, count = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
                    now = min(n, count)
                    self.place(length, now, sequence, self.capacity - room)
                    leave(room - length, sequence, now)
                    leave(room, sequence + now, count - now)
                    continue
                each = min(self.capacity // length, n)
                count = n // each
                for slot in range(each):
                    self.place(length, count, self.sequences, slot * length)
                leave(self.capacity - each * length, self.sequences, count)
                self.sequences += count


def packed(cut: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    cut = stored(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = np.array(sorted(Plan(counts, capacity).rows), np.int64).reshape(-1, 5)
    wide = 2**40
    keys, firsts, sequences, offsets = rows[:, 0] * wide + rows[:, 1], rows[:, 1], rows[:, 3], rows[:, 4]
    buckets = max(1, sum(counts.values()) // rows_per_bucket)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy("length", "bucket")
        .agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(within)).join(before, ["length", "bucket"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank")
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        assign,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed(pieces(docs, public_tokenizers.path(TOKENIZER)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packed(pieces(with_text(docs.select("doc_id", "text")), public_tokenizers.path(TOKENIZER)))
