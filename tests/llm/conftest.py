import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(frame):
    """Rows of (id, text), with the other columns of documents."""

    def make(rows):
        return frame(
            [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOCS
        )

    return make


@pytest.fixture(scope="session")
def prose():
    """Different texts of invented words: (seed, words) to a text."""
    import random

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(words))

    return make
