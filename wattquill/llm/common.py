"""Helpers of the text operators: shared tables, bounded slices of batches, words and hashes.

The package is pickled by value, so executors need no copy of it on their path.
"""

from __future__ import annotations

import sys
import time
import types
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattquill.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules["wattquill.llm"])

SLICE_BYTES = 2_500_000

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: a cut in its lineage that any executor can
    read. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that are over, which it does once the driver's JVM
    has collected their plans: the second time, as threads that end still hold them at first. After
    `stored` nothing reads those files."""
    for wait in (1, 0):
        spark._jvm.System.gc()
        time.sleep(wait)


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """A null text counts as an empty one."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def set_aside(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The needed columns and a struct `_row` of all others, and a function that puts them back.

    Whatever the other columns are called, they can't clash with those of an operator.
    """
    needed = [c for c in df.columns if c in needed]
    others = [c for c in df.columns if c not in needed]
    quoted = [F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(c) if c in needed else F.col("_row")[c].alias(c) for c in df.columns])

    return df.select(*needed, F.struct(*quoted).alias("_row")), back


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most `most` bytes of text; a longer text is a run of its own.

    Afterwards Arrow gives back the memory it holds unused: idle workers of earlier steps live on beside
    the executor's JVM."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for row, n in enumerate(size.tolist()):
        if row > start and held + n > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += n
    yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    column = batch.column(text)
    return column.cast(pa.string()) if not pa.types.is_string(column.type) else column


def once_per_worker(name: str, make: Callable[[], T]) -> T:
    """What `make` returns, kept for later tasks of the same Python worker.

    Code that is pickled by value has new globals in each task; a module entry outlives them.
    """
    kept = sys.modules.setdefault("wattquill_kept", types.ModuleType("wattquill_kept"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


# what parts words: ASCII bytes are made spaces at once, the few others are looked for afterwards
SPACED = bytes(32 if c < 128 and not (chr(c).isalnum() or chr(c) == "_") else c for c in range(256))
OTHERS = r"[^\x00-\x7F\p{L}\p{M}\p{N}]+"


def spaced(texts: pa.Array) -> pa.Array:
    """Strings without nulls, with spaces for all that is no letter, mark, digit or `_`."""
    _, ends, body = texts.buffers()
    if body is None:
        return texts
    body = pa.py_buffer(body.to_pybytes().translate(SPACED))
    texts = pa.Array.from_buffers(texts.type, len(texts), [None, ends, body], offset=texts.offset)
    return pc.replace_substring_regex(texts, OTHERS, " ")


class Words:
    """The words of a run of texts, lower case: maximal runs of letters, marks, digits and `_`.

    `row` has the text of each word (ascending), `code` its place in `names`.
    """

    def __init__(self, texts: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(texts, ""))
        parts = pc.split_pattern(spaced(lowered), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(parts)
        row = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
        full = pc.not_equal(flat, "")
        encoded = flat.filter(full).dictionary_encode()
        self.rows = len(texts)
        self.row = row[full.to_numpy(zero_copy_only=False)]
        self.code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = encoded.dictionary

    def hashes(self) -> np.ndarray:
        """64 bits for each distinct word."""
        names = self.names.to_numpy(zero_copy_only=False).tolist()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))

    def starts(self) -> np.ndarray:
        """Where the words of each text begin, and the end."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit value well spread over all of them (finaliser of SplitMix64)."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def polynomials(word: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """For each `size` neighbours their values as digits to the base, modulo 2^64: runs of double length
    are joined from two, so that the steps grow with the logarithm of the size."""
    out, held = np.zeros(len(word) + 1, np.uint64), 0
    run, length, power = word, 1, base
    while True:
        if size & length:
            n = len(word) - held - length + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out, held = out[:n] * power + run[held : held + n], held + length
        if held == size:
            return out
        n = len(run) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        run, length = run[:n] * power + run[length:], 2 * length
        power = np.uint64(int(power) ** 2 % 2**64)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and hash of each run of `size` words.

    A text with fewer words, but any, has one run: all of them.
    """
    word = mixed(words.hashes())[words.code] if len(words.code) else np.zeros(0, np.uint64)
    starts = words.starts()
    lengths = np.diff(starts)
    odd = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(word) - size + 1)
    run = polynomials(word, size, odd)
    at = np.arange(n)
    whole = words.row[at] == words.row[at + size - 1] if n else np.zeros(0, bool)
    row, at, run = words.row[:n][whole], at[whole], mixed(run[whole])
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        own = np.array(
            [
                int.from_bytes(
                    xxhash.xxh3_64_digest(word[starts[r] : starts[r + 1]].tobytes()), "little"
                )
                for r in short
            ],
            np.uint64,
        )
        row, at, run = np.r_[row, short], np.r_[at, starts[short]], np.r_[run, own]
        order = np.argsort(row, kind="stable")
        row, at, run = row[order], at[order], run[order]
    return row, at - starts[row], run


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
