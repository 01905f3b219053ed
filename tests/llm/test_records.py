import functools
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wattquill.llm import records
from wattquill.llm.registry import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


tokenizer_of = functools.cache(Tokenizer.from_file)


def plain(rows):
    """doc_id, start, n_tokens, ids_crc32 of (doc_id, text) in order."""
    tokenizer, start, out = tokenizer_of(PATH), 0, []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def masked(data):
    register = 0xFFFFFFFF
    for byte in data:
        register ^= byte
        for _ in range(8):
            register = (register >> 1) ^ (0x82F63B78 if register & 1 else 0)
    register ^= 0xFFFFFFFF
    return (((register >> 15) | (register << 17) & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums_equal_the_bitwise_ones():
    strings = [os.urandom(n) for n in (4, 9, 255, 256, 257, 1000, 5000)] + [b"123456789"]
    assert records.Crc32c().masked(strings).tolist() == [masked(s) for s in strings]
    unmasked = (int(records.Crc32c().masked([b"123456789"])[0]) - 0xA282EAD8) & 0xFFFFFFFF
    assert ((unmasked >> 17) | (unmasked << 15) & 0xFFFFFFFF) == 0xE3069283


def test_query_equals_the_plain_encoding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = queries()["op13_records"](spark, small).collect()
    assert sorted(map(tuple, found)) == plain(sorted(map(tuple, docs)))


def test_many_files_nulls_repeats_and_any_order(spark, docs, tmp_path):
    rows = [(7, "seven words are here for number seven"), (None, "no id"), (3, None), (5, "")]
    rows += [(4, f"text {n % 3}") for n in range(300)] + [(9, "long " * 30_000)]
    path = f"file://{tmp_path}/out"
    df = docs(rows).withColumnRenamed("source", "ids").withColumnRenamed("lang", "start")
    records.write(df, path, PATH, shard_bytes=2000)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 3 and sum(m["records"] for m in manifest) == len(rows)
    entries = records.index(spark, path)
    found = records.digest(records.fetch(entries, path)).collect()
    # equal ids may stand in any order: take that of the files
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    left, ordered = list(rows), []
    for r in found:
        ordered.append(next(x for x in left if x[0] == r["doc_id"] and plain([x])[0][2:] == (r["n_tokens"], r["ids_crc32"])))
        left.remove(ordered[-1])
    assert [tuple(r) for r in found] == plain(ordered)
    # a shuffled read of some records only
    some = entries.filter("position % 2 = 0").orderBy("length", "start").coalesce(1)
    again = records.digest(records.fetch(some, path)).collect()
    assert [r["start"] for r in again] == [r["start"] for r in some.collect()]
    assert set(map(tuple, again)) < set(map(tuple, found))


def test_frames_on_disk(spark, docs, tmp_path):
    records.write(docs([(1, "one two"), (2, "three")]), str(tmp_path / "out"), PATH)
    (name,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".records")]
    raw, at = (tmp_path / "out" / name).read_bytes(), 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        assert int.from_bytes(raw[at + 8 : at + 12], "little") == masked(raw[at : at + 8])
        assert int.from_bytes(raw[at + 12 + n : at + 16 + n], "little") == masked(raw[at + 12 : at + 12 + n])
        at += n + 16
    assert at == len(raw)


def test_damage_is_noticed(spark, docs, tmp_path):
    records.write(docs([(1, "one two"), (2, "three")]), str(tmp_path / "out"), PATH)
    (name,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".records")]
    raw = bytearray((tmp_path / "out" / name).read_bytes())
    raw[-6] ^= 1
    (tmp_path / "out" / name).write_bytes(bytes(raw))
    for crc in tmp_path.glob("out/.*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="damaged record"):
        records.fetch(records.index(spark, str(tmp_path / "out")), str(tmp_path / "out")).collect()


def test_empty_table(spark, docs, tmp_path):
    records.write(docs([]), str(tmp_path / "out"), PATH)
    assert records.fetch(records.index(spark, str(tmp_path / "out")), str(tmp_path / "out")).collect() == []
