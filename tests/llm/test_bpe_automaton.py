import hashlib
import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaverlake.llm import bpe_automaton
from quaverlake.llm.bpe_automaton import Automaton, codec, encode_decode, op7_bpe_automaton
from quaverlake.llm.shared import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def ours():
    return codec(open(PATH, encoding="utf-8").read())


TEXTS = [
    "", " ", "Hello, World! it's we'll THEY'RE 'd", "İstanbul İ ΣΣ οΣ ς", "é é ﬁ Å", "a\x1cb \x85 c d e​f",
    "x<|endoftext|>y <|startoftext|> <|END|>", "12345 ١٢ ½ Ⅷ 日本語 한국어 \U0001f600\U0001f468‍\U0001f469", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!???...;;;===###", "z" * 5000, "\x00\x01 �", " ́x", "ẞß STRASSE", " ́ Ω",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(ours, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = ours.encode(text)
    assert list(memoryview(ids).cast("I")) == want
    assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_random_words_same_as_library(ours, library):
    rng = random.Random(0)
    pieces = [s.removesuffix("</w>") for s in library.get_vocab() if s.isascii()]
    texts = [" ".join("".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(40)) for _ in range(150)]
    texts += ["".join(rng.choices("aeinrst", k=rng.randint(1, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0x3000), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(ours.encode(text)).cast("I")) == want.ids, text


def greedy(symbols, ranks):
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: (ranks.get((symbols[i], symbols[i + 1]), 1 << 30), i))
        if (symbols[best], symbols[best + 1]) not in ranks:
            break
        pair = symbols[best], symbols[best + 1]
        out, i = [], 0
        while i < len(symbols):
            if tuple(symbols[i : i + 2]) == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(40))
def test_gadgets_on_random_merges(seed):
    """Every word over a small alphabet, against merging in order of rank."""
    rng = random.Random(seed)
    tokens, merges = list("ab"), []
    while len(merges) < 8:
        pair = rng.choice(tokens), rng.choice(tokens)
        if "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    ranks = {m: i for i, m in enumerate(merges)}
    dfa = Automaton({t: i for i, t in enumerate(tokens)}, merges, "")
    for n in range(1, 11):
        for bits in range(2**n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert [tokens[i] for i in dfa.encode(word.encode())] == greedy(word, ranks), (word, merges)


def test_small_tables_give_the_same(ours, library, monkeypatch):
    """States, arcs and pieces that are dropped when their tables are full, and bytes without a column, change nothing."""
    for name, value in (("STATES_KEPT", 40), ("ARCS_KEPT", 30), ("PIECES_KEPT", 10), ("COLUMNS", 4)):
        monkeypatch.setattr(bpe_automaton, name, value)
    small = bpe_automaton.Codec(open(PATH, encoding="utf-8").read())
    for text in [*TEXTS, "one pass over every word, résumé naïve; again and again one pass 1234"] * 2:
        assert small.encode(text) == ours.encode(text)


def test_rows_and_columns_are_kept(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "a b", 4), (None, "", 5)], "doc_id long, text string, decoded int")
    got = {(r.doc_id, r.text): (bytes(r.ids), r.decoded) for r in encode_decode(df, PATH).collect()}
    assert got[1, None] == (b"", "") and got[None, ""] == (b"", "") and got[1, "a b"][1] == "a</w> b</w>"
    assert encode_decode(df.limit(0), PATH).collect() == []


def test_query_on_table(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op7_bpe_automaton(spark, d).collect()}
    rows = table(spark, d, "documents").collect()
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        want = len(e.ids), hashlib.sha256(array("I", e.ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
        assert got[r.doc_id] == want
    assert len(got) == len(rows)


def test_every_character_is_a_symbol_where_the_library_says_so():
    """Next to a symbol, over all of Unicode; spaces and capitals are others by then."""
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    from quaverlake.llm.bpe_automaton import LATER

    cut = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).pre_tokenizer.pre_tokenize_str
    symbol = regex.compile(r"[^\s\p{L}\p{N}]")
    wrong = []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if not 0xD800 <= code < 0xE000 and not c.isspace() and not regex.match(r"\p{Lu}", c):
            if (len(cut("@" + c)) == 1) != bool(symbol.match(c) or LATER.match(c)):
                wrong.append(hex(code))
    assert not wrong
