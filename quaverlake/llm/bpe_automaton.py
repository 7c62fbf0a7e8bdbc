"""BPE encoding and decoding by a deterministic automaton over tokens.

Merges are compiled in order by the merge gadget (Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA",
2024). The automaton starts as one state with a loop for every base symbol. A merge of u and v into w
splits the state s that arcs labelled u lead to: those arcs now lead to a copy of s without the arc v, and every
state with an arc u gets an arc w to where v led from s. All arcs of one label lead to one state, so the states are
kept as a log: for each label, the arcs its state lost and the time of each loss, and the label whose state it took over when it
was made. An arc of the final automaton is read off that log once and then kept in the transition table.

A word is encoded byte by byte by table-driven transitions. For that the arcs over labels are determinised over bytes: a state holds the labels that have
begun and may go on (each with the label before it) and the one label that ends here, which is unique as the labels of a prefix are. A transition is
worked out from the gadgets on first use and kept in a table that all words share, one row a state, so a word is one pass without a
step back. Reading the ends backwards gives the labels. Decoding emits the arcs' labels.

Reads tokenizer files of the tokenizers library with a BPE model, an end-of-word suffix, a normaliser of NFC, white space folding and
lower-casing, a splitting pattern and byte-level symbols; other kinds are refused. Added tokens that stand in a text become their ids, as in that library.

Defined results: a null text counts as empty and has no tokens and the empty string as decoded text. Rows and columns of the input are kept;
`ids` (little-endian unsigned 32-bit integers) and `decoded` are added and replace columns of these names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: What a worker keeps of pieces (some 200 bytes each), states (some 500 bytes each) and arcs; when full, they are dropped and found anew.
PIECES_KEPT = 150_000
STATES_KEPT = 100_000
ARCS_KEPT = 200_000
#: Columns of the transition table. Bytes get columns in the order in which they turn up; those that get none are kept aside in a dictionary.
COLUMNS = 64
#: Labels below a place up to which a state tells whether the label before it forbids some of them.
FEW = 24
#: Marks the last byte of a word.
END = 0x100

#: Letters, and in the last line numbers, that the pattern's engine knows and the library, with the tables of Unicode 16, takes for symbols.
LATER = regex.compile(
    r"[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d-\u209f\ua7cb-\ua7cc\ua7ce-\ua7cf\ua7d2\ua7d4\ua7da\ua7dc-\ua7dd"
    r"\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010d50-\U00010d65\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
    r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6]"
)
#: Capitals of Unicode 16 and 17, which the library lower-cases and this Python may not.
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
LATER_CAPITALS |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


class Automaton:
    """The compiled merges. `arc(u, t)`: may token t follow token u inside a word?"""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        size = max(vocab.values(), default=-1) + 1
        self.left, self.right, self.time = ([-1] * size for _ in range(3))
        self.lost: dict[int, int] = {}  # (u << 32 | v) -> time at which u's state lost its arc v
        self.arcs: dict[int, bool] = {}
        made = lambda s: self.time[vocab[s]] >= 0 or len(s.removesuffix(suffix) or s) == 1
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.time[w] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            if not (made(a) and made(b) and self._leaves(u, v, r)):
                continue  # no arcs of these labels follow each other, so this merge never applies
            self.left[w], self.right[w], self.time[w] = u, v, r
            self.lost[u << 32 | v] = r
        # Labels by their bytes, the last of a word standing for itself and the suffix: (place << 9 | byte) -> place.
        self.spelled: dict[int, int] = {}
        self.token, self.size = [-1], [0] * size
        byte_of = {x: i for i, x in enumerate(_byte_symbols())}
        for label, token in vocab.items():
            # Tokens that no merge makes are base symbols of one character, with or without the suffix.
            if made(label):
                ending = suffix != "" and label.endswith(suffix) and label != suffix
                text = [byte_of[x] for x in (label.removesuffix(suffix) if ending else label)]
                place = 0
                for k, x in enumerate(text, 1):
                    place = self.spelled.setdefault(place << 9 | (x | END if ending and k == len(text) else x), len(self.token))
                    if place == len(self.token):
                        self.token.append(-1)
                self.token[place], self.size[token] = token, len(text)
        # Labels that go on from a place, where they are few.
        self.below: list[tuple[int, ...] | None] = [()] * len(self.token)
        for key, place in reversed(self.spelled.items()):
            all_of = self.below[key >> 9], self.below[place]
            few = None if None in all_of else (*all_of[0], *all_of[1], *((self.token[place],) if self.token[place] >= 0 else ()))
            self.below[key >> 9] = few if few is not None and len(few) <= FEW else None
        self.last = END if suffix else 0
        self.forget()

    def forget(self) -> None:
        """Leaves two states: a row of misses, and the start, at which only the front has begun and no label stands before it."""
        self.begun: list[tuple[int, ...]] = [(), (0,)]  # place << 32 | 1 + label before, or 0 for none
        self.ends = [-1, -1]
        self.known: dict[tuple[int, ...], int] = {(0,): 1}
        self.rows = array("i", bytes(4 * COLUMNS * 2))  # state and column -> COLUMNS * next state, 0 where not yet known
        self.aside: dict[int, int] = {}  # (state << 9 | byte) -> next state, for bytes without a column and for the last bytes of words
        self.column = bytearray([COLUMNS - 1]) * 256
        self.columns = 0

    def _leaves(self, u: int, t: int, now: int) -> bool:
        """Follows the log: u's state inherits the losses of its right part up to the time u was made; a longer label t is missing
        if a part that t starts with was lost no later than t's next part was made."""
        until = now
        while True:
            part, made = t, now
            while True:
                at = self.lost.get(u << 32 | part)
                if at is not None and at < until and at <= made:
                    return False
                if self.left[part] < 0:
                    break
                made = min(made, self.time[part])
                part = self.left[part]
            if self.right[u] < 0:
                return True
            until = min(until, self.time[u])
            u = self.right[u]

    def arc(self, u: int, t: int) -> bool:
        key = u << 32 | t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            known = self.arcs[key] = self._leaves(u, t, 1 << 62)
        return known

    def _step(self, state: int, byte: int) -> int:
        """The transition: labels that have begun go on by the byte; the one that ends and has an arc from the label before it is the next label."""
        end, begun = -1, []
        for x in self.begun[state]:
            place = self.spelled.get(x >> 32 << 9 | byte)
            if place is not None:
                before = x & 0xFFFFFFFF
                token = self.token[place]
                if end < 0 <= token and (not before or self.arc(before - 1, token)):
                    end = token
                few = self.below[place]
                if few is None or not before:
                    begun.append(place << 32 | before)
                elif few:
                    # Where all arcs are there, the label before does not matter; where none is, nothing can go on. So paths meet again.
                    open_ = [self.arc(before - 1, t) for t in few]
                    if any(open_):
                        begun.append(place << 32 | (0 if all(open_) else before))
        if end < 0:
            raise ValueError(f"no label ends with the byte {byte & 0xFF}")
        begun.append(end + 1)
        key = tuple(begun)
        to = self.known.setdefault(key, len(self.ends))
        if to == len(self.ends):
            self.begun.append(key)
            self.ends.append(end)
            self.rows.frombytes(bytes(4 * COLUMNS))
        return to

    def _walk(self, word: bytes, last: int) -> list[int]:
        """The path of a word with transitions that are not yet in the table; they are put there."""
        state, path = 1, []
        for byte in word:
            to = self.aside.get(state << 9 | byte) if self.column[byte] == COLUMNS - 1 else self.rows[state * COLUMNS + self.column[byte]] // COLUMNS
            if not to:
                to = self._step(state, byte)
                if self.column[byte] == COLUMNS - 1 and self.columns < COLUMNS - 1:
                    self.column[byte] = self.columns
                    self.columns += 1
                if self.column[byte] == COLUMNS - 1:
                    self.aside[state << 9 | byte] = to
                else:
                    self.rows[state * COLUMNS + self.column[byte]] = to * COLUMNS
            path.append(to * COLUMNS)
            state = to
        self.aside[state << 9 | last] = self._step(state, last)
        return path

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        if not word:
            return []
        front, last, rows, state = word[:-1], word[-1] | self.last, self.rows, COLUMNS
        path = [state := rows[state + c] for c in front.translate(self.column)]
        end = self.aside.get(state // COLUMNS << 9 | last) if state else None
        if end is None:
            if len(self.ends) >= STATES_KEPT:
                self.forget()
            path = self._walk(front, last)
            end = self.aside[(path[-1] if path else COLUMNS) // COLUMNS << 9 | last]
        token = self.ends[end]
        out, i, ends, size = [token], len(word) - self.size[token], self.ends, self.size
        while i:
            token = ends[path[i - 1] // COLUMNS]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out


def _byte_symbols() -> list[str]:
    """The printable stand-ins for bytes: printable Latin-1 stands for itself, the rest for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent:
    """The last `most` entries put or found, about: when the younger half is full, the older half is dropped."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Normalising, splitting, encoding and decoding as a tokenizer file says."""

    def __init__(self, config: str):
        c = json.loads(config)
        model, norm, pre = c["model"], c["normalizer"], c["pre_tokenizer"]
        kinds = [x["type"] for x in norm["normalizers"]], [x["type"] for x in pre["pretokenizers"]]
        if model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or c["decoder"] or c["post_processor"]:
            raise NotImplementedError("not a tokenizer file of the kind that this reads")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.dfa = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.added = {x["content"]: x["id"] for x in c["added_tokens"]}
        self.labels = {i: s for s, i in (model["vocab"] | self.added).items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # The same pattern for ASCII, where the faster engine can tell letters and numbers.
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.pieces = Recent(PIECES_KEPT)

    def _word(self, word: str) -> bytes:
        return array("I", self.dfa.encode(word.encode())).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A piece without white space; neither normalising nor splitting looks beyond it."""
        if chunk.isascii():
            low = chunk.lower()
            return self._word(low) if low.isalpha() else b"".join(map(self._word, self.ascii_words.findall(low)))
        # Lower-casing is by character, without the final form of sigma.
        low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        shown = low
        if max(low) >= "\u0558":
            low = low.translate(LATER_CAPITALS)
            shown = LATER.sub("\ue000", low)
        if shown.isalpha():
            return self._word(low)
        return b"".join([self._word(low[x.start() : x.end()]) for x in self.words.finditer(shown)])

    def _plain(self, text: str) -> bytes:
        known, out = self.pieces, []
        get = known.young.get
        for x in text.split():
            got = get(x)
            if got is None:
                got = known.get(x)
                if got is None:
                    got = self._chunk(x)
                    if len(x) <= 64:
                        known.put(x, got)
                get = known.young.get
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split_added and any(x in text for x in self.added):
            return b"".join(array("I", [self.added[x]]).tobytes() if x in self.added else self._plain(x) for x in self.split_added.split(text))
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):  # Python's split takes these for white space, the pattern does not
            return b"".join(self._chunk(x) for x in regex.split(r"\p{White_Space}+", text))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[str, Codec] = {}


def codec(config: str) -> Codec:
    if config not in _codecs:
        _codecs[config] = Codec(config)
    return _codecs[config]


def _run(batches: Iterator[pa.RecordBatch], config: str, text_col: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Output batches hold about `limit` bytes of tokens, so a batch of very long texts is answered in parts."""
    c = codec(config)
    for batch in batches:
        texts, ids, decoded, start, size = batch.column(text_col), [], [], 0, 0
        rest = [i for i, f in enumerate(batch.schema) if f.name not in ("ids", "decoded")]
        for row in range(len(texts)):
            ids.append(c.encode(texts[row].as_py() or ""))
            decoded.append(c.decode(ids[-1]))
            size += len(ids[-1])
            if size >= limit or row == len(texts) - 1:
                part = batch.slice(start, row + 1 - start)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*(batch.schema[i].name for i in rest), "ids", "decoded"])
                ids, decoded, start, size = [], [], row + 1, 0


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """The rows of docs with `ids` and `decoded`. The file is read on the driver; its size is that of a vocabulary."""
    config = Path(tokenizer_path).read_text(encoding="utf-8")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    return docs.mapInArrow(lambda it: _run(it, config, text_col), ", ".join([*kept, "ids binary", "decoded string"]))


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    return encoded.select(*columns, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")), "doc_id")
