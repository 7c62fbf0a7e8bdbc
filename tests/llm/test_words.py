import numpy as np
import pytest

from quaverlake.llm import registry
from quaverlake.llm import words as W


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bytes(97 + b for b in bits[:n]), bytes(98 - b for b in bits[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096, 100_000])
def test_crafted_words_differ(n):
    """These words hash alike by any polynomial modulo a power of two."""
    a, b = thue_morse(n)
    data = np.frombuffer(b" ".join([a, b, a, b]), np.uint8)
    got, bounds = W.word_hashes(data, np.array([0, len(data)]))
    assert got[0] == got[2] != got[1] == got[3] and bounds.tolist() == [0, 4]


def test_hashes_follow_words_alone(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abcdefgh \n\t\xc3\xa9", np.uint8), 200_000)
    whole, _ = W.word_hashes(data, np.array([0, len(data)]))
    words = bytes(data).split()
    assert len(set(whole.tolist())) == len(set(words)) == len({(h, w) for h, w in zip(whole.tolist(), words, strict=True)})
    monkeypatch.setattr(W, "PIECE", 1000)
    monkeypatch.setattr(W, "_pow", {})
    assert (W.word_hashes(data, np.array([0, len(data)]))[0] == whole).all()


def test_sql_entries_are_texts():
    assert all(isinstance(x, str) for x in registry.SQL.values()) and registry.SQL.keys() <= registry.QUERIES.keys()
