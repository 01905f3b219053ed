"""The random values of `hashing` for very many steps at once, in numpy.

As a DataFrame expression a digest costs microseconds a row, most of them for its text of hex digits.
Here the MD5 of thousands of short texts is worked out side by side, a chunk at a time that fits a
core's cache. The functions are pickled by value, so executors need no copy of the package.
"""

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# an MD5 block less the mark of the end and the length
MOST_BYTES = 55
CHUNK = 32_768

_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = tuple(int(abs(math.sin(k + 1)) * 2**32) for k in range(64))
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))

Word = int | np.ndarray


def md5(words: list[Word], shape: tuple[int, ...]) -> list[np.ndarray]:
    """The four words of the MD5 of messages of one block, from its 16 words: each a whole number or an
    array of 32 bits that broadcasts to the shape."""
    # until the first word of full shape, all steps of a row have the same state
    same = (*shape[:-1], 1)
    wide = next((k for k, word in enumerate(words) if not isinstance(word, int) and word.shape == shape), 0)
    a, b, c, d = (np.full(same, value, np.uint32) for value in _STATE)
    f, turned = np.empty(same, np.uint32), np.empty(same, np.uint32)
    for k in range(64):
        if k == wide:
            a, b, c, d = (np.broadcast_to(value, shape).copy() for value in (a, b, c, d))
            f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            word = words[k]
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            word = words[(5 * k + 1) % 16]
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            word = words[(3 * k + 5) % 16]
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            word = words[7 * k % 16]
        f += a
        if isinstance(word, int):
            f += np.uint32((word + _ADDED[k]) % 2**32)
        elif word.size < f.size:
            f += word + np.uint32(_ADDED[k])
        else:
            f += word
            f += np.uint32(_ADDED[k])
        left = _TURNS[k // 16][k % 4]
        np.left_shift(f, np.uint32(left), out=turned)
        f >>= np.uint32(32 - left)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [value + np.uint32(begin) for value, begin in zip((a, b, c, d), _STATE, strict=True)]


def uniforms(digest: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`hashing.uniform` 0 and 1 of a digest: 52 of its bits each, which a double holds with the half added."""
    a, b, c, d = (value.byteswap() for value in digest)
    first = a * 2.0**20 + (b >> np.uint32(12)) + 0.5
    second = (b & np.uint32(0xFFF)) * 2.0**40 + c * 2.0**8 + (d >> np.uint32(24)) + 0.5
    return first / 2.0**52, second / 2.0**52


def normals(digest: list[np.ndarray]) -> np.ndarray:
    """`hashing.normal` of a digest."""
    first, second = uniforms(digest)
    return np.sqrt(-2.0 * np.log(first)) * np.cos(2.0 * math.pi * second)


def _blocks(texts: list[bytes]) -> np.ndarray:
    """The 16 words of each text, padded with zeros."""
    return np.frombuffer(b"".join(text.ljust(64, b"\0") for text in texts), "<u4").reshape(len(texts), 16).astype(np.uint32)


def step_words(at: int, days: int, per_day: int) -> list[Word]:
    """The 16 words of what comes after the first `at` bytes of a message, by day and step of the day: the
    number of the step, the mark of the end and the length. 0 where there is nothing."""
    numbers = [b"%d\x80" % step for step in range(days * per_day)]
    table = _blocks([b"\0" * at + number for number in numbers])
    table[:, 14] = [8 * (at + len(number) - 1) for number in numbers]
    columns = [np.ascontiguousarray(table[:, k]).reshape(days, per_day) for k in range(16)]
    return [column if column.any() else 0 for column in columns]


def normals_by_step(prefix: str, days: int, per_day: int) -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[slice, np.ndarray]]]:
    """A function of keys and days (0, 1, ..) that gives, for runs of them, the `normal` of the digest of
    `prefix:key:step` for each step of the day: a row for each day."""
    tables: dict[int, list[Word]] = {}

    def runs(keys: np.ndarray, day: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        most = max(1, CHUNK // per_day)
        for begin in range(0, len(keys), most):
            texts, which = np.unique(keys[begin : begin + most], return_inverse=True)
            texts = [f"{prefix}:{key}:".encode() for key in texts.tolist()]
            size = np.array([len(text) for text in texts])[which]
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            blocks = _blocks(texts)[which]
            for a, b in zip(cuts, cuts[1:]):
                at = int(size[a])
                if at not in tables:
                    tables[at] = step_words(at, days, per_day)
                part = slice(begin + a, begin + b)
                words: list[Word] = []
                for k, steps in enumerate(tables[at]):
                    own = blocks[a:b, k, None]
                    words.append((own if own.any() else 0) if isinstance(steps, int) else own | steps[day[part]])
                yield part, normals(md5(words, (b - a, per_day)))

    return runs


def watt_hours_by_step(
    prefix: str, hours: np.ndarray, means: np.ndarray, share: float
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: rows of customer_id, _day and _kind become customer_id, _day, and wh and hours,
    lists of the steps of the day. `hours` has the hour of each day and step of the day, `means` the
    expected kWh of each kind, day and step, and the noise has `share` of it as its deviation."""
    days, per_day = means.shape[1:]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = normals_by_step(prefix, days, per_day)
        for batch in batches:
            ids, day, kind = (batch.column(name).to_numpy() for name in ("customer_id", "_day", "_kind"))
            for part, values in noise(ids, day):
                kwh = means[kind[part], day[part]] * (1.0 + share * values)
                wh = np.floor(np.maximum(kwh, 0.0) * 1000.0 + 0.5).astype(np.int64)
                ends = np.arange(0, wh.size + 1, per_day, dtype=np.int32)
                lists = (pa.ListArray.from_arrays(ends, pa.array(values.ravel())) for values in (wh, hours[day[part]]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(day[part]), *lists], ["customer_id", "_day", "wh", "hours"])

    return drawn
