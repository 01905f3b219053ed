import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wattquill.llm import common


def test_slices_return_unused_memory(monkeypatch):
    """After the last run of a batch, and not before, Arrow is asked for the memory it holds unused."""
    done = []

    class Pool:
        def release_unused(self):
            done.append("released")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 10, "c" * 30, "d"]})
    for part in common.slices(batch, "text", 20):
        done.append(part.column("text").to_pylist())
    assert done == [["a" * 10, None, "b" * 10], ["c" * 30], ["d"], "released"]


def test_words_are_those_of_the_pattern():
    texts = [
        "A_b c-d,e\x00f\tg", "", None, "  ", "Äpfel und Öl… «Zitat»—x", "日本語、テキスト。１２", "été ‍­½ ²",
        "\x7f\x1f~^`|", "🤖x🤖 y", "".join(map(chr, range(0xD800))), " ".join(map(chr, range(0xE000, 0x3FFFF, 7))),
    ]
    array = pa.array(["cut off", *texts, "too"]).slice(1, len(texts))
    lowered = pc.utf8_lower(pc.fill_null(array, ""))
    want = [[w for w in x if w] for x in pc.split_pattern_regex(lowered, r"[^\p{L}\p{M}\p{N}_]+").to_pylist()]
    words = common.Words(array)
    names = words.names.to_pylist()
    got = [[] for _ in texts]
    for row, code in zip(words.row.tolist(), words.code.tolist(), strict=True):
        got[row].append(names[code])
    assert got == want
    assert common.Words(pa.array([None, ""], pa.string())).row.tolist() == []


def test_joined_runs_equal_those_of_single_steps():
    rng, base = np.random.default_rng(1), np.uint64(0x9E3779B97F4A7C15)
    for n in (0, 1, 3, 49, 50, 51, 200):
        word = rng.integers(0, 2**64, n, np.uint64)
        for size in (1, 2, 3, 4, 5, 8, 50):
            want = np.zeros(max(0, n - size + 1), np.uint64)
            for k in range(size):
                want = want * base + word[k : k + len(want)]
            assert common.polynomials(word, size, base).tolist() == want.tolist(), (n, size)
