"""Token ids in length-delimited binary files, with checksums and an offset index beside each file.

A file is a row of frames: length of the payload (8 bytes, little-endian), masked CRC-32C of those
8 bytes, the payload, masked CRC-32C of the payload; readers of this common record framing can read
it. A payload is one document: a byte that says whether there is a doc_id, the doc_id (8 bytes), a
byte with the width of an id, the ids in that width (2 bytes if the vocabulary allows it, else 4).
The index of a file has three 8-byte numbers for each record (offset of its frame, length of its
payload, ids before it in the file) and a masked CRC-32C of all that, so that a reader can fetch any
records in any order without reading the others.

Ranges of (doc_id, hash of the text, row number) with about `SHARD_BYTES` of text are sorted, encoded
and become one file each, so a doc_id that a third of all rows share is spread over many files. A task
writes under a name of its own and reports it in one row; the manifest
is those rows as a Parquet table, which only holds files of tasks that Spark committed. Files of lost
or repeated attempts stay unread.

Defined cases: a null text is an empty one, only the end id; a null doc_id comes first and stays
null; repeated rows are written each, in the order of their texts' hashes; an empty table gives an
empty manifest. A frame or index whose checksum is wrong raises. Other columns are not written.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattquill.llm.common import once_per_worker, slices, table, texts_of, with_text
from wattquill.llm.packing import TOKENIZER, Encoder
from wattquill.session import shared_dir

END = 1
SHARD_BYTES = 16_000_000
READ_BYTES = 4_000_000
SLICE = 5_000_000
HEAD = 10
POLYNOMIAL = 0x82F63B78  # CRC-32C, bits reversed
MASK_DELTA = 0xA282EAD8
BLOCK = 256


class Crc32c:
    """CRC-32C of many byte strings at a time, by numpy.

    Bytes are laid out in blocks of `BLOCK`, with zeros before the first one: leading zeros leave a
    register of zero as it is. All blocks of all strings advance together, 4 bytes a step; then the
    blocks of each string are joined, as the register is linear in what it has read.
    """

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
        tables = [byte]
        for _ in range(3):
            last = tables[-1]
            tables.append((last >> 8) ^ byte[last & 0xFF])
        pair = np.arange(65536)
        self.low = tables[3][pair & 0xFF] ^ tables[2][pair >> 8]
        self.high = tables[1][pair & 0xFF] ^ tables[0][pair >> 8]
        zeros = pair.astype(np.uint32), (pair << 16).astype(np.uint32)
        for _ in range(BLOCK // 4):
            zeros = tuple(self.step(z) for z in zeros)
        self.skip_low, self.skip_high = zeros

    def step(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFFF] ^ self.high[x >> 16]

    def skip(self, x: np.ndarray) -> np.ndarray:
        """The register after `BLOCK` zeros."""
        return self.skip_low[x & 0xFFFF] ^ self.skip_high[x >> 16]

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Registers after each row of 4-byte words, begun at zero."""
        out = np.zeros(len(words), np.uint32)
        for a in range(0, len(words), 4096):
            columns = np.ascontiguousarray(words[a : a + 4096].T)
            register = np.zeros(columns.shape[1], np.uint32)
            for column in columns:
                register = self.step(register ^ column)
            out[a : a + 4096] = register
        return out

    def masked(self, strings: list[bytes]) -> np.ndarray:
        """Masked checksums; each string has 4 bytes or more."""
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        blocks = -(-size // BLOCK)
        ends = np.cumsum(blocks)
        buffer = np.zeros(int(ends[-1]) * BLOCK if len(ends) else 0, np.uint8)
        for string, end, n in zip(strings, (ends * BLOCK).tolist(), size.tolist(), strict=True):
            buffer[end - n : end] = np.frombuffer(string, np.uint8)
            buffer[end - n : end - n + 4] ^= 0xFF
        block = self.rows(buffer.view("<u4").reshape(-1, BLOCK // 4))
        order = np.argsort(-blocks, kind="stable")
        first, most = (ends - blocks)[order], blocks[order]
        register = np.zeros(len(strings), np.uint32)
        for k in range(int(most[0]) if len(most) else 0):
            n = int(np.searchsorted(-most, -k))
            register[:n] = self.skip(register[:n]) ^ block[first[:n] + k]
        crc = np.empty_like(register)
        crc[order] = register
        crc = ~crc
        return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def checksums() -> Crc32c:
    return once_per_worker("crc32c", Crc32c)


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, and the folder in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def framed(payloads: list[bytes]) -> list[bytes]:
    crc = checksums()
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    head = np.frombuffer(b"".join(lengths), "<u4").reshape(-1, 2).copy()
    head ^= np.array([0xFFFFFFFF, 0], np.uint32)
    of_length = ~crc.rows(head)
    of_length = (((of_length >> 15) | (of_length << 17)) + np.uint32(MASK_DELTA)).astype("<u4")
    of_payload = crc.masked(payloads).astype("<u4")
    return [
        b"".join((n, of_length[k].tobytes(), payload, of_payload[k].tobytes()))
        for k, (n, payload) in enumerate(zip(lengths, payloads, strict=True))
    ]


def unframed(frames: list[memoryview]) -> list[bytes]:
    """Payloads of whole frames; raises if one is damaged."""
    payloads = [bytes(f[12:-4]) for f in frames]
    for frame, again in zip(frames, framed(payloads), strict=True):
        if frame != again:
            raise ValueError("damaged record")
    return payloads


def write(docs: DataFrame, path: str, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Files, indexes and manifest of `docs` (doc_id, text) under `path`, in ascending doc_id order."""
    docs = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    size = docs.agg(F.sum(F.octet_length("text") + HEAD + 16)).first()[0] or 0
    fs, folder = opened(path)
    fs.create_dir(folder, recursive=True)
    # equal ids are told apart by their text, and equal rows need no order
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row")]
    docs = docs.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_per_worker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        width = 2 if len(encoder.is_end) <= 65536 else 4
        fs, folder = opened(path)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:07d}-{uuid.uuid4().hex}"
        index, offset, before = [], 0, 0
        with fs.open_output_stream(f"{folder}/{name}.records") as out:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    ids, n = encoder.encode(texts_of(part, "text"))
                    ends = np.cumsum(n).tolist()
                    payloads = []
                    for doc_id, a, b in zip(part.column("doc_id").to_pylist(), [0, *ends], ends):
                        head = (b"\0" if doc_id is None else b"\1") + (doc_id or 0).to_bytes(8, "little", signed=True)
                        payloads.append(head + bytes([width]) + np.append(ids[a:b], np.uint32(END)).astype(f"<u{width}").tobytes())
                    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
                    starts = np.cumsum(size + 16) - (size + 16) + offset
                    n = n + 1
                    index.append(np.stack([starts, size, np.cumsum(n) - n + before], axis=1))
                    offset += int((size + 16).sum())
                    before += int(n.sum())
                    for frame in framed(payloads):
                        out.write(frame)
        if not index:
            fs.delete_file(f"{folder}/{name}.records")
            return
        rows = np.concatenate(index).astype("<i8")
        with fs.open_output_stream(f"{folder}/{name}.index") as out:
            out.write(rows.tobytes())
            out.write(checksums().masked([rows.tobytes()]).astype("<u4").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "name": [name], "records": [len(rows)], "tokens": [before], "bytes": [offset]},
            schema=pa.schema([("shard", pa.int64()), ("name", pa.string())] + [(c, pa.int64()) for c in ("records", "tokens", "bytes")]),
        )

    manifest = (
        docs.repartitionByRange(max(1, -(-size // shard_bytes)), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(save, "shard long, name string, records long, tokens long, bytes long")
    )
    manifest.write.parquet(posixpath.join(path, "manifest"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """name, position, offset, length and start of each record: `start` counts the ids of all before.

    One task for each file. Any rows of it, in any order, can be given to `fetch`.
    """
    manifest = spark.read.parquet(posixpath.join(path, "manifest"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file, so this window is small; it never sees records
    based = manifest.select("name", "records", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(path)
        for batch in batches:
            for name, records, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{folder}/{name}.index") as file:
                    raw = file.read()
                if len(raw) != records * 24 + 4 or checksums().masked([raw[:-4]]).astype("<u4").tobytes() != raw[-4:]:
                    raise ValueError(f"damaged index {name}")
                rows = np.frombuffer(raw[:-4], "<i8").reshape(-1, 3)
                for a in range(0, records, 10_000):
                    some = rows[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(some), pa.string()),
                            pa.array(np.arange(a, a + len(some)), pa.int64()),
                            *(pa.array(np.ascontiguousarray(some[:, k])) for k in (0, 1)),
                            pa.array(some[:, 2] + base),
                        ],
                        ["name", "position", "offset", "length", "start"],
                    )

    files = max(1, manifest.count())
    return based.repartitionByRange(files, "name").mapInArrow(
        entries, "name string, position long, offset long, length long, start long"
    )


def fetch(entries: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 4 bytes each) of index rows, in their order.

    Neighbours in a file are read together, `READ_BYTES` at most at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = opened(path)
        file, current = None, None
        try:
            for batch in batches:
                names, offsets, lengths, starts = (
                    batch.column(c).to_pylist() for c in ("name", "offset", "length", "start")
                )
                a = 0
                while a < len(names):
                    b, end = a + 1, offsets[a] + lengths[a] + 16
                    while (
                        b < len(names)
                        and names[b] == names[a]
                        and offsets[b] == end
                        and end + lengths[b] + 16 - offsets[a] <= READ_BYTES
                    ):
                        end += lengths[b] + 16
                        b += 1
                    if current != names[a]:
                        if file:
                            file.close()
                        file, current = fs.open_input_file(f"{folder}/{names[a]}.records"), names[a]
                    file.seek(offsets[a])
                    raw = memoryview(file.read(end - offsets[a]))
                    if len(raw) != end - offsets[a]:
                        raise ValueError(f"{current} ends early")
                    payloads = unframed(
                        [raw[offsets[k] - offsets[a] : offsets[k] - offsets[a] + lengths[k] + 16] for k in range(a, b)]
                    )
                    ids = [np.frombuffer(p, f"<u{p[9]}", offset=HEAD).astype("<u4").tobytes() for p in payloads]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int.from_bytes(p[1:9], "little", signed=True) if p[0] else None for p in payloads], pa.int64()),
                            pa.array(starts[a:b], pa.int64()),
                            pa.array([len(i) // 4 for i in ids], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    a = b
        finally:
            if file:
                file.close()

    return entries.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digest(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return digest(fetch(index(spark, path), path))
